"""Relational operators of the point store: joins over edges, set operations, upserts, frontier and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs (id, nb) without loops."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("nb")).union(edges.select("dst", "src"))
    return both.filter("id <> nb").distinct()


def neighbour_keys(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Directed neighbours with the local point's energy, null where the target is not stored here."""
    return edges.distinct().join(points.select(F.col("id").alias("dst"), "energy"), "dst", "left").select("src", "dst", "energy")


def points_by_keys(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points of (pos, id) in input order; an id that is not stored raises."""
    missing = wanted.join(points, "id", "left_anti").select("id").limit(5).collect()
    if missing:
        raise KeyError([r[0] for r in missing])
    return wanted.join(points, "id").orderBy("pos")


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest version of every key: updates (by order) win over the table. Both have the same columns but order."""
    versions = table.withColumn(order, F.lit(None).cast(updates.schema[order].dataType)).unionByName(updates)
    values = [c for c in versions.columns if c not in keys and c != order]
    latest = F.max_by(F.struct(*values), F.struct(F.col(order).isNotNull(), F.col(order))).alias("latest")
    return versions.groupBy(*keys).agg(latest).select(*keys, "latest.*")


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with those rows whose key it does not hold, each key once."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new)


def frontier(points: DataFrame, k: int, ceiling: float | None = None) -> DataFrame:
    """The k open points of lowest energy in every search; nulls come first unless a ceiling is set (inclusive)."""
    rows = points.filter("status = 'OPEN'")
    if ceiling is not None:
        rows = rows.filter(F.col("energy") <= ceiling)
    w = Window.partitionBy("search").orderBy(F.col("energy").asc_nulls_first(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def statistics(points: DataFrame) -> DataFrame:
    """Counts, energy range, frontier size and water level of every search in one pass."""
    is_open, closed = F.col("status") == "OPEN", F.col("status") == "CLOSED"
    return points.groupBy("search").agg(
        F.count("*").alias("n_points"),
        F.count("energy").alias("n_energy"),
        F.min("energy").alias("min_energy"),
        F.max("energy").alias("max_energy"),
        F.count_if(is_open).alias("n_open"),
        F.count_if(closed).alias("n_closed"),
        F.max(F.when(closed, F.col("energy"))).alias("high_water"),
        F.min(F.when(is_open, F.col("energy"))).alias("water_level"),
    )


def bounded_statistics(points: DataFrame, buckets: int) -> DataFrame:
    """The statistics of every bucket of ids, as one partition of a store would report them."""
    return statistics(points.withColumn("search", F.pmod("id", F.lit(buckets)))).withColumnRenamed("search", "bucket")


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows whose key is in gone; a null key is never deleted."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and both directions of the new ones. Repeats are kept, readers take distinct pairs."""
    return edges.unionByName(new.select("src", "dst")).unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those that join a pair of gone, in either direction."""
    both = gone.select("src", "dst").union(gone.select("dst", "src"))  # repeats do not matter to an anti-join
    return edges.join(both, ["src", "dst"], "left_anti")


def set_values(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """table with column replaced where changes (one row per key) has a value; unknown keys are ignored."""
    new = changes.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def status_points(status: DataFrame, points: DataFrame, wanted: str, *, stored_only: bool = False) -> DataFrame:
    """id and energy of ids with a status; the energy of an id that is not stored is null, unless only stored ones count."""
    rows = status.filter(F.col("status") == wanted).select("id")
    return rows.join(points.select("id", "energy"), "id", "inner" if stored_only else "left")


def lowest_neighbour(edges: DataFrame, energies: DataFrame) -> DataFrame:
    """For every source the neighbour of lowest energy (ties: smallest id); neighbours without energy do not count."""
    rows = edges.select("src", "dst").join(energies.filter("energy is not null").select(F.col("id").alias("dst"), "energy"), "dst")
    return rows.groupBy("src").agg(F.min(F.struct("energy", "dst")).alias("low")).select("src", "low.dst", "low.energy")


def end_point_report(ends: DataFrame, status: DataFrame, edges: DataFrame) -> DataFrame:
    """For every end point: whether it is stored with a status, which, its degree, and whether it counts as reached.

    An end point is reached if it is in the frontier or has an edge.
    """
    wanted = ends.select("id").distinct()
    touching = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).join(F.broadcast(wanted) if _is_small(wanted) else wanted, "id", "left_semi")
    degree = touching.groupBy("id").agg(F.count("*").alias("degree"))
    rows = wanted.join(status.select("id", "status"), "id", "left").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    is_open, closed = F.coalesce(F.col("status") == "OPEN", F.lit(False)), F.coalesce(F.col("status") == "CLOSED", F.lit(False))
    return rows.select("id", is_open.alias("in_frontier"), closed.alias("searched"), "degree", (is_open | (F.col("degree") > 0)).alias("reached"))


def _is_small(rows: DataFrame, bound: int = 100_000) -> bool:
    return rows.limit(bound + 1).count() <= bound
