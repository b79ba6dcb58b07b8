"""A point store in a folder: Parquet tables of points, edges, statuses and searches, written a version at a time.

A version of a table is a folder of its own: either the whole table or rows added to the versions before it. The rows of
the manifest that name versions make them current, all those of a step at once. A step that is lost half-way leaves
folders that nothing names, so a store is always read as after its last whole step. A step adds rows only: a point that
becomes explored and a status that becomes CLOSED are added anew, and of rows with one key the furthest counts. Tables
of more than PARTS versions are written whole again, so no row is rewritten at every step.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance
from ..operators import canonical, store
from ..operators.search import PARTS
from ..storage import scratch, written

TABLES = {
    "point": "key array<bigint>, labels array<int>, energy double, explored boolean",
    "edge": "src array<bigint>, dst array<bigint>",
    "status": "search int, key array<bigint>, status string",
    "search": "search int, description string, width double",
    "end": "search int, key array<bigint>, kind string",
}
_MANIFEST = "name string, version bigint, step bigint, whole boolean"


@dataclass
class PointStore:
    spark: SparkSession
    path: str
    xi: float
    delta: int
    elements: list[str]

    # ------------------------------------------------------------ folder

    @classmethod
    def create(cls, spark: SparkSession, path: str, xi: float, delta: int, elements: list[str]) -> PointStore:
        """A new store with empty tables; a folder that is there already raises."""
        if delta < 1 or xi <= 0 or not elements:
            raise ValueError("xi and delta must be positive, and there must be elements")
        spark.createDataFrame([(json.dumps({"xi": xi, "delta": delta, "elements": list(elements)}),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        out = cls(spark, path, xi, delta, list(elements))
        out.put({name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}, first=True)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PointStore:
        meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/metadata").collect()))
        out = cls(spark, path, meta["xi"], meta["delta"], meta["elements"])
        if missing := set(TABLES) - set(out._current()):
            raise ValueError(f"tables are missing: {sorted(missing)}")
        return out

    def _current(self) -> dict[str, list[int]]:
        """The versions that make up every table, oldest first."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        out = {}
        for name in {r.name for r in rows}:
            base = max(r.version for r in rows if r.name == name and r.whole)
            out[name] = sorted(r.version for r in rows if r.name == name and r.version >= base)
        return out

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        versions = self._current()[name]
        rows = self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{name}/{v}" for v in versions))
        if len(versions) > 1 and name == "point":
            rows = rows.groupBy("key").agg(F.first("labels").alias("labels"), F.first("energy").alias("energy"), F.max("explored").alias("explored"))
        if len(versions) > 1 and name == "status":
            rows = rows.groupBy("search", "key").agg(F.min("status").alias("status"))  # CLOSED before OPEN
        return rows

    def put(self, tables: dict[str, DataFrame], whole: bool = True, first: bool = False) -> None:
        """New versions of tables, or rows added to them, which become current together."""
        current = {} if first else self._current()
        step = max((v[-1] for v in current.values()), default=-1) + 1
        rows = []
        for name, df in tables.items():
            version = current.get(name, [-1])[-1] + 1
            columns = [c.split(" ")[0] for c in TABLES[name].split(", ")]
            df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")
            rows.append((name, version, step, whole))
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, tables: dict[str, DataFrame]) -> None:
        """Rows added to tables; those of too many versions are written whole."""
        self.put(tables, whole=False)
        if many := [name for name, versions in self._current().items() if len(versions) > PARTS]:
            self.put({name: self.table(name) for name in many})

    # ------------------------------------------------------------ searches

    def create_search(self, description: str, starts: DataFrame, goals: DataFrame, width: float = 0.005) -> int:
        """Number of a new search from starts to goals (key, labels): its ends are stored and its starts open.

        Ends of other compositions than the store's, or none, raise ValueError.
        """
        ends = starts.select("key", "labels", F.lit("start").alias("kind")).union(goals.select("key", "labels", F.lit("goal").alias("kind"))).distinct()
        kinds = {r.kind for r in ends.select("kind").distinct().collect()}
        labels = [list(dict.fromkeys(self.elements)).index(e) for e in self.elements]
        if kinds != {"start", "goal"}:
            raise ValueError("a search needs starts and goals")
        if not ends.filter(F.col("labels") != F.array(*map(F.lit, labels))).isEmpty():
            raise ValueError("ends must have the elements of the store")
        number = (self.table("search").agg(F.max("search")).first()[0] or 0) + 1
        points = self._new_points(ends.select("key", "labels").distinct(), self.table("point"))
        opened = ends.filter("kind = 'start'").select(F.lit(number).alias("search"), "key", F.lit("OPEN").alias("status"))
        self.add({
            "point": points,
            "search": self.spark.createDataFrame([(number, description, width)], TABLES["search"]),
            "end": ends.select(F.lit(number).alias("search"), "key", "kind"),
            "status": opened,
        })
        return number

    def _new_points(self, found: DataFrame, points: DataFrame) -> DataFrame:
        """Rows of the points of found (key, labels) that the table does not hold, with their energies."""
        fresh = found.join(points.select("key"), "key", "left_anti")
        energies = canonical.energies_of(fresh, self.xi, self.delta)
        return fresh.join(energies, "key").select("key", "labels", "energy", F.lit(False).alias("explored"))

    def _search(self, number: int):
        row = self.table("search").filter(F.col("search") == number).first()
        if row is None:
            raise ValueError(f"no search {number}")
        return row

    def is_complete(self, number: int) -> bool:
        """Whether a goal has a status."""
        goals = self.table("end").filter((F.col("search") == number) & (F.col("kind") == "goal"))
        return not self.table("status").filter(F.col("search") == number).join(goals.select("key"), "key", "left_semi").isEmpty()

    def set_width(self, number: int, width: float) -> None:
        """The band above the water level that a step explores, from the next step on."""
        self._search(number)
        rows = self.table("search").withColumn("width", F.when(F.col("search") == number, F.lit(float(width))).otherwise(F.col("width")))
        self.put({"search": rows})

    def step(self, number: int, batch: int = 1000) -> bool:
        """Explores the open points in the band above the water level, batch at most; whether there was any.

        The width is read anew at every step. Edges of points that another search explored already are not computed again.
        """
        width, points, status, edges = self._search(number).width, self.table("point"), self.table("status"), self.table("edge")
        mine = status.filter(F.col("search") == number)
        opened = mine.filter("status = 'OPEN'").join(points, "key").select("key", "labels", "energy", "explored")
        level = opened.agg(F.min("energy")).first()[0]
        if level is None:
            return False
        with scratch():
            front = written(opened.filter(F.col("energy") <= level + width).orderBy("energy", "key").limit(batch), "front")
            new = written(canonical.neighbour_keys(front.filter("not explored"), self.delta).select(F.col("key").alias("src"), F.col("neighbour").alias("dst")), "edges")
            reached = edges.union(new).join(front.select(F.col("key").alias("src"), "labels"), "src").select(F.col("dst").alias("key"), "labels").distinct()
            reached = written(reached, "reached")
            fresh = reached.select("key").join(mine.select("key"), "key", "left_anti").select(F.lit(number).alias("search"), "key", F.lit("OPEN").alias("status"))
            done = front.select(F.lit(number).alias("search"), "key", F.lit("CLOSED").alias("status"))
            explored = front.select("key", "labels", "energy", F.lit(True).alias("explored"))
            self.add({"point": self._new_points(reached, points).union(explored), "edge": new, "status": fresh.union(done)})
        return True

    def run(self, number: int, max_steps: int, batch: int = 1000) -> int:
        """Steps until a goal has a status, nothing is open or max_steps are made; the number of steps made."""
        for k in range(max_steps):
            if self.is_complete(number) or not self.step(number, batch):
                return k
        return max_steps

    # ------------------------------------------------------------ reports

    def status(self) -> DataFrame:
        """Statistics of every search."""
        rows = self.table("status").join(self.table("point").select("key", "energy"), "key", "left")
        return store.statistics(rows)

    def check(self, number: int) -> DataFrame:
        """Every end point of a search: kind, whether it is in the frontier, searched, reached, and its degree."""
        ends = self.table("end").filter(F.col("search") == number)
        name = lambda c: distance.key_text(F.col(c))
        edges = self.table("edge").select(name("src").alias("src"), name("dst").alias("dst"))
        status = self.table("status").filter(F.col("search") == number).select(name("key").alias("id"), "status")
        ids = ends.select(name("key").alias("id"), "kind")
        return ids.join(store.end_point_report(ids.select("id"), status, edges), "id")

    def barrier(self, number: int) -> float | None:
        """The highest energy of the points a search has explored; null if none."""
        closed = self.table("status").filter((F.col("search") == number) & (F.col("status") == "CLOSED"))
        return closed.join(self.table("point").select("key", "energy"), "key").agg(F.max("energy")).first()[0]
