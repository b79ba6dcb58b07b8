"""Domain rows as projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors() -> Column:
    pk, size = F.col("p_partkey"), F.col("p_size").cast("long")
    zero = F.lit(0).cast("long")
    return F.array(F.array(pk % 5 + 3, zero, zero), F.array(pk % 3 - 1, F.floor(pk / 5.0) % 5 + 3, zero), F.array(size % 3 - 1, (pk + size) % 3 - 1, size % 5 + 3))


def lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and three integer lattice vectors per part; lower triangular, so always invertible."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _vectors().alias("vectors"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, search, status (OPEN, CLOSED or null) and energy (null for every 13th) per order."""
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED")
    energy = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("search"), status.alias("status"), energy.alias("energy"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed src -> dst per line item; repeated edges are kept."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and energy of the points that edges run between."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("energy"))


#: Intervals that a cell edge of the projected crystals is divided into.
DELTA = 12


def crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, three lattice vectors, labels and flat integer coordinates of one to three atoms per part."""
    pk, size = F.col("p_partkey"), F.col("p_size").cast("long")
    ks = F.sequence(F.lit(0).cast("long"), pk % 3)
    labels = F.transform(ks, lambda k: F.when((k == 0) | ((k == 1) & (pk % 2 == 0)), 0).otherwise(1))
    at = lambda k: F.array((pk * (k + 1) + k * k * 5) % DELTA, (size * (k + 2) + k) % DELTA, (pk + size * k + k * 3) % DELTA)
    return read(spark, sf_dir, "part").select(pk.alias("id"), _vectors().alias("vectors"), labels.alias("labels"), F.flatten(F.transform(ks, at)).alias("coords"))
