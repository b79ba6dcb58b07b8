"""Attempts of searches as lines of JSON, and what a phase takes over from the results of an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.barrier import ATTEMPT

_PREVIOUS = "search bigint, xi double, delta int, ceiling double, barrier double, best_barrier double, energies array<double>"


def write(attempts: DataFrame, path: str) -> None:
    """One line for every attempt; nulls are left out."""
    attempts.write.json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Attempts as they were written; what a line lacks is null. A line that is no JSON raises."""
    return spark.read.schema(ATTEMPT).option("mode", "FAILFAST").json(path)


def previous(spark: SparkSession, path: str) -> DataFrame:
    """search, xi, delta and ceiling to go on from: the best barrier of each search among the lines of a result.

    A barrier is best_barrier, else barrier, else the highest energy of the path, else the ceiling of the attempt. A
    line without a search counts as search 0. xi and delta are the finest that reached the best barrier; if lines name
    none, they are null. Searches without a barrier are left out.
    """
    rows = spark.read.schema(_PREVIOUS).option("mode", "FAILFAST").json(path)
    reached = F.coalesce("best_barrier", "barrier", F.array_max("energies"), "ceiling")
    rows = rows.select(F.coalesce("search", F.lit(0)).alias("search"), "xi", "delta", reached.alias("barrier")).filter("barrier is not null")
    best = rows.groupBy("search").agg(F.min_by(F.struct("xi", "delta", "barrier"), F.struct("barrier", F.coalesce("xi", F.lit(float("inf"))), -F.coalesce("delta", F.lit(0)))).alias("b"))
    return best.select("search", "b.xi", "b.delta", F.col("b.barrier").alias("ceiling"))
