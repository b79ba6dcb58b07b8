"""Graph search over stored edges as DataFrame supersteps: rings, energy-ordered flooding and paths.

Every superstep writes its state to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch, written
from .supersteps import paths_along

#: Parts of an append-only table after which they are rewritten as one.
PARTS = 8


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def appended(parts: list[DataFrame], fresh: DataFrame) -> list[DataFrame]:
    """The parts of a table and one more; many parts become one, so each row is rewritten a few times at most."""
    parts = [*parts, fresh]
    return parts if len(parts) <= PARTS else [written(united(parts), "parts")]


def rings(pairs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id and ring (0 for the start) of all points at most depth steps away; pairs is (id, nb), both directions."""
    seen = written(start.select("id").distinct().withColumn("ring", F.lit(0)), "ring")
    last = seen
    for k in range(1, depth + 1):
        reached = last.join(pairs, "id").select(F.col("nb").alias("id")).distinct()
        last = written(reached.join(seen, "id", "left_anti").withColumn("ring", F.lit(k)), "ring")
        if last.isEmpty():
            break
        seen = seen.union(last)
    return seen


def flood(pairs: DataFrame, energies: DataFrame, start: DataFrame, goals: DataFrame, *, width: float = 0.0, batch: int = 1000, max_steps: int = 50) -> DataFrame:
    """id, parent, energy and step of the points flooded from start, in steps of rising energy.

    A step explores the open points at most width above the lowest open energy (batch of them at most, lowest first).
    The points seen are a table that is only appended to; a step rewrites the front alone.
    It ends when a goal is reached, nothing is open, or after max_steps steps. Points without energy are not entered.
    """
    known = energies.filter("energy is not null")
    wanted = goals.select("id").distinct()
    first = start.select("id").distinct().join(known, "id").select("id", F.lit(None).cast("long").alias("parent"), "energy", F.lit(0).alias("step"))
    with scratch() as keep:
        fresh = front = written(first, "flood")
        seen = [fresh]
        for step in range(1, max_steps + 1):
            if not fresh.join(wanted, "id", "left_semi").isEmpty():
                break
            level = front.agg(F.min("energy")).first()[0]
            if level is None:
                break
            now = written(front.filter(F.col("energy") <= level + width).orderBy("energy", "id").limit(batch).select("id"), "now")
            reached = now.join(pairs, "id").groupBy(F.col("nb")).agg(F.min("id").alias("parent")).withColumnRenamed("nb", "id")
            entered = reached.join(united(seen).select("id"), "id", "left_anti").join(known, "id")
            fresh = written(entered.select("id", "parent", "energy", F.lit(step).alias("step")), "flood")
            front = written(front.join(now, "id", "left_anti").select("id", "energy").unionByName(fresh.select("id", "energy")), "front")
            seen = appended(seen, fresh)
        return united([keep(p) for p in seen])


def barrier(flooded: DataFrame) -> DataFrame:
    return flooded.agg(F.max("energy").alias("barrier"), F.count("*").alias("n_points"))


def path_to(flooded: DataFrame, goal: int) -> DataFrame:
    """hop and id along the parents from a goal back to the start."""
    return paths_to(flooded, flooded.filter(F.col("id") == goal)).select("hop", "id")


def paths_to(flooded: DataFrame, goals: DataFrame) -> DataFrame:
    """goal, hop and id along the parents from every goal (id) back to its start."""
    return paths_along(flooded.select("id", "parent"), goals.select("id"))
