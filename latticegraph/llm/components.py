"""Connected components of an edge table, as DataFrame supersteps with written tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge table of longs.

    Alternates large-star and small-star steps: each is one map-side combined minimum per node and one join, whose
    skewed sides the adaptive planner splits, and the number of rounds is logarithmic. Nulls and loops are ignored.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") < F.col("b")).distinct()
    e = materialize(e, "edges")
    seen = _digest(e)
    while seen[0]:
        # large star: every larger neighbour of a node moves to the smallest member of its star
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "star-minima")  # written, so the join below can split a hot node
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b").filter(F.col("a") < F.col("b")).distinct()
        large = materialize(large, "large-star")
        # small star: a node and its smaller neighbours move to the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = materialize(down.groupBy("u").agg(F.min("v").alias("low")), "star-minima")
        small = down.join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b")).union(low.select(F.col("low").alias("a"), F.col("u").alias("b")))
        step = materialize(small.filter(F.col("a") < F.col("b")).distinct(), "small-star")
        release(e)
        release(large)
        release(least)
        release(low)
        now = _digest(step)
        e, done = step, now == seen
        seen = now
        if done:
            break
    low = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return low.union(e.select("a", "a").distinct())
