"""Queries of the engine's own operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import crystal_queries, function_queries, object_queries, partition_queries, relational_queries, store_queries

PLANS = (store_queries, crystal_queries, relational_queries, function_queries, object_queries, partition_queries)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lattice forms: scan, array algebra, reduction, catalog join and lexicographic minimum."""
    return QUERIES["k5_lattice_form"](spark, sf_dir)
