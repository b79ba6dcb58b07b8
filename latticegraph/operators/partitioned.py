"""A point store dealt over numbered partitions: owners of keys, routing, levels, completion and a flood.

A point, its status and the edges that leave it belong to the partition that a digest of its key names, so any number of
processes agree on owners without asking. Tables are folders by partition: a reader that owns a range of partitions
scans those folders alone. A hot partition is written by several tasks, because rows are rebalanced by bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calculators import PairCalculator, Provider
from ..storage import scratch, written
from .canonical import energies_of, neighbour_keys
from .search import appended, united


def owner(name: Column, n: int) -> Column:
    """Partition of a key given as text: the first eight hexadecimal digits of its MD5, modulo n."""
    if n < 1:
        raise ValueError("there must be partitions")
    return (F.conv(F.substring(F.md5(name.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int")


def key_owner(key: Column, n: int) -> Column:
    """Partition of a key given as an array of numbers."""
    return owner(F.array_join(key, " "), n)


def write(rows: DataFrame, path: str) -> None:
    """Rows with a column partition, as a folder for each partition."""
    rows.hint("rebalance", F.col("partition")).write.partitionBy("partition").parquet(path)


def read(spark: SparkSession, path: str, schema: str, n: int, owned: Iterable[int] | None = None) -> DataFrame:
    """The rows of the owned partitions (all if None); only their folders are scanned.

    A number that is no partition raises ValueError.
    """
    rows = spark.read.schema(f"{schema}, partition int").parquet(path)
    if owned is None:
        return rows
    owned = sorted(set(owned))
    if owned and not 0 <= owned[0] <= owned[-1] < n:
        raise ValueError(f"partitions are 0 to {n - 1}")
    return rows.filter(F.col("partition").isin(owned))


def guard(rows: DataFrame, owned: Iterable[int]) -> DataFrame:
    """Rows unchanged; one of a partition that is not owned raises when it is reached."""
    mine = F.col("partition").isin(sorted(set(owned)))
    message = F.concat(F.lit("partition is not owned: "), F.col("partition").cast("string"))
    return rows.withColumn("partition", F.when(mine, F.col("partition")).otherwise(F.raise_error(message).cast("int")))


def route(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs (src, dst) with their owners and whether dst stays with src or goes to another partition's mailbox."""
    rows = pairs.withColumns({"partition": owner(F.col("src"), n), "to": owner(F.col("dst"), n)})
    return rows.withColumn("local", F.col("partition") == F.col("to"))


def levels(points: DataFrame, n: int) -> DataFrame:
    """search, partition and the least open energy of points (search, partition, status, energy).

    Every search has all partitions; one without an open point that has an energy stands at infinity.
    """
    low = points.groupBy("search", "partition").agg(F.min(F.when(F.col("status") == "OPEN", F.col("energy"))).alias("low"))
    grid = points.select("search").distinct().withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(low, ["search", "partition"], "left").select("search", "partition", F.coalesce("low", F.lit(float("inf"))).alias("level"))


def completion(points: DataFrame, ends: DataFrame) -> DataFrame:
    """search and whether any end (search, id) has a status among points (search, id, status)."""
    reached = points.filter("status is not null").select("search", "id").distinct().withColumn("reached", F.lit(True))
    found = ends.distinct().join(reached, ["search", "id"], "left")
    return found.groupBy("search").agg(F.coalesce(F.max("reached"), F.lit(False)).alias("complete"))


def flood(start: DataFrame, goals: DataFrame, xi: float, delta: int, n: int, *, width: float = 0.0, batch: int = 100, max_steps: int = 50, provider: Provider = PairCalculator) -> DataFrame:
    """key, partition, energy, step and from_mail of the points that a flood over n partitions reaches from start.

    A step explores, in every partition, the open points at most width above the least level of all partitions, batch of
    them at most. Neighbours of the same partition are entered at once and others through the mailbox, which is read
    before the next step; from_mail says which way a point came if only one way led to it (local counts first). It ends
    when a goal (key) is seen, nothing is open, or after max_steps. All starts share one list of labels.
    """
    first = start.select("key", "labels").distinct()
    wanted = goals.select("key").distinct()
    columns = ["key", "labels", key_owner(F.col("key"), n).alias("partition"), "energy"]
    by_level = Window.partitionBy("partition").orderBy("energy", "key")
    with scratch() as keep:
        fresh = first.join(energies_of(first, xi, delta, provider), "key").select(*columns, F.lit(0).alias("step"), F.lit(False).alias("from_mail"))
        fresh = front = written(fresh, "flood")
        seen = [fresh]
        for step in range(1, max_steps + 1):
            if not fresh.join(wanted, "key", "left_semi").isEmpty():
                break
            level = front.agg(F.min("energy")).first()[0]
            if level is None:
                break
            now = front.filter(F.col("energy") <= level + width).withColumn("rank", F.row_number().over(by_level)).filter(F.col("rank") <= batch)
            now = written(now.select("key", "labels"), "now")
            found = neighbour_keys(now, delta).select(F.col("neighbour").alias("key"), "labels", (key_owner(F.col("neighbour"), n) != key_owner(F.col("key"), n)).alias("mailed"))
            reached = found.groupBy("key").agg(F.first("labels").alias("labels"), F.min("mailed").alias("from_mail"))
            entered = written(reached.join(united(seen).select("key"), "key", "left_anti"), "entered")
            fresh = entered.join(energies_of(entered, xi, delta, provider), "key").select(*columns, F.lit(step).alias("step"), "from_mail")
            fresh = written(fresh, "flood")
            rest = front.join(now.select("key"), "key", "left_anti")
            front = written(rest.unionByName(fresh.select(*rest.columns)), "front")
            seen = appended(seen, fresh)
        return united([keep(p) for p in seen]).select("key", "partition", "energy", "step", "from_mail")
