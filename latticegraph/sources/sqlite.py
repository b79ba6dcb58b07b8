"""Tables of SQLite files, read in ranges of rows, and stores kept in such files taken over into a point store.

The files must lie in a folder that the driver and all executors share. They are opened for reading only.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance
from ..functions.calculators import Provider
from ..operators import canonical
from ..storage import scratch, written
from .points import PointStore

#: Rows of a table that one task reads.
ROWS = 100_000
# Tables and columns of a store, and the ending of the files of its partitions.
STORE = {
    "point": "id bigint, cnf string, value double, explored bigint",
    "edge": "source_id bigint, target_id bigint, target_cnf string",
    "metadata": "delta bigint, xi double, element_list string",
    "search_process": "id bigint, description string",
    "search_start_point": "search_id bigint, start_point_id bigint",
    "search_end_point": "search_id bigint, end_point_id bigint",
    "search_point_status": "search_id bigint, point_id bigint, point_status string",
    "incoming_point": "search_id bigint, cnf string",
}
PARTITION_SUFFIX = ".partition.db"


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=30)


def read(spark: SparkSession, paths: list[str], table: str, schema: str, rows: int = ROWS) -> DataFrame:
    """file and the columns of schema of a table in every file; ranges of rowids are read by tasks of their own.

    Files without rows give none; a file without the table raises.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    quoted = ", ".join(f'"{n}"' for n in names)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["file"]:
                with closing(_open(file)) as db:
                    low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
                if low is not None:
                    starts = list(range(low, high + 1, rows))
                    yield pd.DataFrame({"file": [file] * len(starts), "low": starts})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, low in zip(batch["file"], batch["low"]):
                with closing(_open(file)) as db:
                    found = db.execute(f'SELECT {quoted} FROM "{table}" WHERE rowid BETWEEN ? AND ?', (low, low + rows - 1))
                    while part := found.fetchmany(10_000):
                        yield pd.DataFrame({"file": [file] * len(part)} | {n: pd.Series([r[k] for r in part], dtype=object) for k, n in enumerate(names)})

    files = spark.createDataFrame([(str(p),) for p in paths], "file string")
    parts = files.repartition(max(1, len(paths)), "file").mapInPandas(ranges, "file string, low bigint")
    return canonical.spread(parts, "file", "low").mapInPandas(fetch, f"file string, {schema}")


def store_files(path: str) -> list[str]:
    """The files of a store: one file, or those of all partitions of a folder; none raises ValueError."""
    if Path(path).is_file():
        return [path]
    found = sorted(str(p) for p in Path(path).glob(f"*{PARTITION_SUFFIX}"))
    if not found:
        raise ValueError(f"no store in {path}")
    return found


def _metadata(paths: list[str]) -> tuple[float, int, list[str]]:
    """xi, delta and elements, which all files must share; a file that lacks a table raises ValueError."""
    seen = set()
    for path in paths:
        with closing(_open(path)) as db:
            tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            if missing := set(STORE) - tables:
                raise ValueError(f"tables are missing in {path}: {sorted(missing)}")
            seen.add(db.execute("SELECT xi, delta, element_list FROM metadata").fetchone())
    if len(seen) != 1 or None in seen:
        raise ValueError("the files must have one xi, delta and list of elements")
    xi, delta, elements = seen.pop()
    return float(xi), int(delta), json.loads(elements)


def load(spark: SparkSession, source: str, path: str, *, width: float = 0.005, provider: Provider | None = None, rows: int = ROWS) -> PointStore:
    """A new point store in the folder path with all that the store at source (a file or a folder of partitions) holds.

    Points are told apart by key; of one that stands in several files the energy that is set and the exploration that
    was done count. Edges without a target key take that of their target's number in the same file. Keys that wait in a
    mailbox become open points of their search, unless they have a status there. Points without an energy get that of
    provider, or keep none and are then never explored. width is that of every search.
    """
    paths = store_files(source)
    xi, delta, elements = _metadata(paths)
    labels = F.array(*(F.lit(list(dict.fromkeys(elements)).index(e)) for e in elements))
    table = {name: read(spark, paths, name, schema, rows) for name, schema in STORE.items() if name != "metadata"}
    with scratch():
        points = written(table["point"].select("file", "id", distance.parse_key(F.col("cnf")).alias("key"), F.col("value").alias("energy"), (F.coalesce("explored", F.lit(0)) != 0).alias("explored")), "points")
        ids = points.select("file", "id", "key")

        def keyed(name: str, column: str) -> DataFrame:
            return table[name].withColumnRenamed(column, "id").join(ids, ["file", "id"])

        mail = written(table["incoming_point"].select(F.col("search_id").cast("int").alias("search"), distance.parse_key(F.col("cnf")).alias("key")).distinct(), "mail")
        all_points = points.select("key", "energy", "explored").union(mail.select("key", F.lit(None).cast("double"), F.lit(False)))
        merged = written(all_points.groupBy("key").agg(F.min("energy").alias("energy"), F.max("explored").alias("explored")), "merged")
        if provider is not None:
            lacking = merged.filter("energy is null").select("key")
            computed = canonical.energies_of(lacking, xi, delta, provider).withColumnRenamed("energy", "own")
            merged = merged.join(computed, "key", "left").withColumn("energy", F.coalesce("energy", "own")).drop("own")
        edges = keyed("edge", "source_id").select("file", F.col("key").alias("src"), F.col("target_id").alias("id"), "target_cnf")
        edges = edges.join(ids.withColumnRenamed("key", "near"), ["file", "id"], "left").select("src", F.coalesce(distance.parse_key(F.col("target_cnf")), "near").alias("dst"))
        status = keyed("search_point_status", "point_id").select(F.col("search_id").cast("int").alias("search"), "key", F.upper("point_status").alias("status"))
        waiting = mail.join(status.select("search", "key"), ["search", "key"], "left_anti").select("search", "key", F.lit("OPEN").alias("status"))
        status = status.union(waiting).groupBy("search", "key").agg(F.min("status").alias("status"))  # CLOSED before OPEN
        ends = [keyed(f"search_{k}_point", f"{k}_point_id").select(F.col("search_id").cast("int").alias("search"), "key", F.lit(kind).alias("kind")) for k, kind in (("start", "start"), ("end", "goal"))]
        searches = table["search_process"].groupBy(F.col("id").cast("int").alias("search")).agg(F.min("description").alias("description"))
        out = PointStore.create(spark, path, xi, delta, elements)
        out.put({
            "point": merged.withColumn("labels", labels),
            "edge": edges.filter("dst is not null").distinct(),
            "status": status,
            "search": searches.withColumn("width", F.lit(float(width))),
            "end": ends[0].union(ends[1]).distinct(),
        })
    return out
