"""A point store as bucketed tables: points, edges and statuses that lie together by point, so joins by point move nothing.

Every table is cut into the same number of buckets by the point it is joined on and sorted by it inside a bucket: points
and statuses by id, edges by src. Edges are stored in both directions, each pair once, so neighbours of a point stand in
its bucket. Edges whose target matters are kept a second time, by dst. The tables are Spark tables of a database in
the shared folder, so the buckets are known to the planner; one file a bucket and step is written, because rows are dealt out by bucket first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..storage import shared_dir

#: The column by which a table is cut.
KEYS = {"point": "id", "status": "id", "edge": "src", "incoming": "dst"}


@dataclass
class BucketedStore:
    spark: SparkSession
    database: str
    buckets: int = 64

    @classmethod
    def create(cls, spark: SparkSession, database: str, points: DataFrame, edges: DataFrame, status: DataFrame, buckets: int = 64) -> BucketedStore:
        """A new database of points (id, energy), edges (src, dst) and statuses (id, search, status); one that is there raises."""
        if spark.catalog.databaseExists(database):
            raise ValueError(f"{database} is there already")
        spark.sql(f"CREATE DATABASE `{database}` LOCATION '{shared_dir(spark)}/{database}'")
        out = cls(spark, database, buckets)
        pairs = store.neighbours(edges).select(F.col("id").alias("src"), F.col("nb").alias("dst"))
        for name, rows in {"point": points.select("id", "energy"), "status": status.select("id", "search", "status"), "edge": pairs, "incoming": edges.select("src", "dst").distinct()}.items():
            out._write(name, rows)
        return out

    def _write(self, name: str, rows: DataFrame, mode: str = "error") -> None:
        key = KEYS[name]
        rows.repartition(self.buckets, key).write.mode(mode).bucketBy(self.buckets, key).sortBy(key).format("parquet").saveAsTable(f"`{self.database}`.`{name}`")

    def table(self, name: str) -> DataFrame:
        if name not in KEYS:
            raise ValueError(f"no table {name}")
        return self.spark.table(f"`{self.database}`.`{name}`")

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows added to a table, in its buckets; an added bucket is a file of its own, and Spark sorts a bucket of many files."""
        self._write(name, rows, "append")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.database}` CASCADE")

    # ------------------------------------------------------------ joins by point, without an exchange

    def neighbours(self) -> DataFrame:
        """Undirected pairs (id, nb)."""
        return self.table("edge").select(F.col("src").alias("id"), F.col("dst").alias("nb"))

    def neighbour_keys(self) -> DataFrame:
        """Directed edges with the energy of their target, null where it is not stored."""
        points = self.table("point").select(F.col("id").alias("dst"), "energy")
        return self.table("incoming").join(points, "dst", "left").select("src", "dst", "energy")

    def foreign_neighbours(self) -> DataFrame:
        """Directed edges whose target is not stored."""
        return self.table("incoming").join(self.table("point").select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")

    def points_with(self, status: str) -> DataFrame:
        """id and energy of points with a status; the energy of a point that is not stored is null."""
        return store.status_points(self.table("status"), self.table("point"), status)

    def membership(self, status: str) -> DataFrame:
        """Distinct sources of edges that have a status."""
        marked = self.table("status").filter(F.col("status") == status).select(F.col("id").alias("src"))
        return self.table("edge").select("src").distinct().join(marked, "src", "left_semi").withColumnRenamed("src", "id")

    def new_frontier(self) -> DataFrame:
        """Distinct neighbours of points that are not closed."""
        closed = self.table("status").filter("status = 'CLOSED'").select("id")
        return self.table("edge").select(F.col("src").alias("id")).distinct().join(closed, "id", "left_anti")

    def unseen(self, seen: DataFrame) -> DataFrame:
        """Distinct points with edges that another bucketed table of ids does not have."""
        return self.table("edge").select(F.col("src").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")

    def degrees(self) -> DataFrame:
        return self.table("edge").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
