"""Queries of the partitioned store, of results read back and of grids of resolutions, with SQL for DuckDB."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, partitioned
from ..sources import results
from ..sources import tables as T
from ..storage import shared_dir, written
from .crystal_queries import _crystals, _text
from .store_queries import _EDGE, _POINT

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Partitions of the stores of these queries.
PARTITIONS = 16


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _owner(name: str) -> str:
    return f"(('0x' || md5({name}::VARCHAR)[1:8])::BIGINT % {PARTITIONS})::INT"


_DEALT = f"{_POINT}, dealt AS (SELECT *, {_owner('id')} AS part FROM point)"


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).withColumn("partition", partitioned.owner(F.col("id"), PARTITIONS))


def _store(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/partitions-{uuid.uuid4().hex}"
    partitioned.write(_dealt(spark, sf_dir), path)
    return path


_SCHEMA = "id bigint, search bigint, status string, energy double"


@query("s12_partitioned_store", f"""WITH {_DEALT} SELECT part AS "partition", count(*) AS n, count(energy) AS n_energy, count(*) FILTER (status = 'CLOSED') AS n_explored, min(energy) AS low, max(energy) AS high FROM dealt GROUP BY 1""")
def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written to folders by owner and read back: statistics of every partition."""
    rows = partitioned.read(spark, _store(spark, sf_dir), _SCHEMA, PARTITIONS)
    return rows.groupBy("partition").agg(F.count("*").alias("n"), F.count("energy").alias("n_energy"), F.count_if(F.col("status") == "CLOSED").alias("n_explored"), F.min("energy").alias("low"), F.max("energy").alias("high"))


@query("s16_owned_partitions", f"""WITH {_DEALT} SELECT id, part AS "partition", status, energy FROM dealt WHERE part BETWEEN 4 AND 7""")
def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that the owner of partitions 4 to 7 reads; no other folder is scanned."""
    rows = partitioned.read(spark, _store(spark, sf_dir), _SCHEMA, PARTITIONS, range(4, 8))
    return partitioned.guard(rows, range(4, 8)).select("id", "partition", "status", "energy")


@query("g8_routed_neighbours", f"""WITH {_EDGE}, r AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst)
SELECT {_owner('src')} AS "partition", {_owner('dst')} AS "to", {_owner('src')} = {_owner('dst')} AS local, count(*) AS n FROM r GROUP BY ALL""")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours stay with their source and how many go to the mailbox of each other partition."""
    pairs = T.edges(spark, sf_dir).filter("src <> dst").distinct()
    return partitioned.route(pairs, PARTITIONS).groupBy("partition", "to", "local").agg(F.count("*").alias("n"))


@query("g13_partition_levels", f"""WITH {_DEALT}, g AS (SELECT DISTINCT search, p::INT AS p FROM point, range(0, {PARTITIONS}) t(p)),
l AS (SELECT search, part AS p, min(energy) AS low FROM dealt WHERE status = 'OPEN' GROUP BY ALL)
SELECT search, p AS "partition", low AS level, min(low) OVER (PARTITION BY search) AS global_level FROM g LEFT JOIN l USING (search, p)""")
def partition_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every partition (null where nothing is open) and the level of its search."""
    rows = partitioned.levels(_dealt(spark, sf_dir), PARTITIONS)
    least = rows.groupBy("search").agg(F.min("level").alias("global_level"))  # a row for every search
    finite = lambda c: F.when(F.col(c) < float("inf"), F.col(c)).alias(c)
    return rows.join(least, "search").select("search", "partition", finite("level"), finite("global_level"))


@query("g13_completion", f"""WITH {_POINT}, e AS (SELECT DISTINCT o_custkey % 3 AS search, s_suppkey AS id FROM orders, supplier WHERE s_suppkey % 3 = o_custkey % 3)
SELECT e.search, coalesce(bool_or(status IS NOT NULL), false) AS complete FROM e LEFT JOIN point ON point.id = e.id AND point.search = e.search GROUP BY 1""")
def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search has reached an end: the searches share the suppliers' numbers as ends, dealt by remainder."""
    ends = T.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("search"), F.col("s_suppkey").alias("id"))
    return partitioned.completion(T.points(spark, sf_dir), ends)


@query("s17_results_read_back", """WITH r AS (SELECT l_orderkey AS search, count(*) AS n, max(l_extendedprice) AS barrier FROM lineitem GROUP BY 1)
SELECT search, n, barrier FROM r""")
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts written as JSON and read back: the points and the barrier of every one."""
    rows = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("search")).agg(F.collect_list(F.struct("l_linenumber", "l_extendedprice", F.array("l_partkey").alias("key"))).alias("steps"))
    steps = F.sort_array("steps")
    rows = rows.select("search", F.lit(0).alias("attempt"), F.lit(True).alias("found"), F.size("steps").alias("iterations"), F.transform(steps, lambda s: s["key"]).alias("path"), F.transform(steps, lambda s: s["l_extendedprice"]).alias("energies"))
    rows = rows.withColumns({"barrier": F.array_max("energies"), "ceiling": F.lit(None).cast("double"), "dropout": F.lit(0.0), "xi": F.lit(1.0), "delta": F.lit(T.DELTA)})
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    results.write(rows, path)
    return results.read(spark, path).select("search", F.size("path").cast("long").alias("n"), "barrier")


@query("g11_partitioned_flood")
def partitioned_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of flooding over sixteen partitions from every key, a flood for each list of labels."""
    alike = _crystals(spark, sf_dir).select(F.lit(0).alias("id"), "v", "labels", "coords").distinct()
    keys = canonical.canonical_keys(canonical.spread(alike, "v", "labels", "coords"), T.DELTA)
    keys = written(keys.filter("key is not null").select("key", "labels").distinct(), "keys")
    out = None
    for row in keys.select("labels").distinct().orderBy("labels").collect():  # a few compositions
        start = keys.filter(F.col("labels") == F.array(*map(F.lit, row.labels)))
        found = partitioned.flood(start, start.select("key").limit(0), 1.0, T.DELTA, PARTITIONS, width=0.5, batch=20, max_steps=2)
        found = found.select(F.lit(" ".join(map(str, row.labels))).alias("labels"), _text(F.col("key")).alias("key"), "partition", F.round("energy", 6).alias("energy"), "step", "from_mail")
        out = found if out is None else out.union(found)
    return out


_GRID = ((0.8, 10), (0.8, 20), (1.5, 10), (1.5, 20))


@query("v15_neighbours_by_resolution")
def neighbours_by_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of neighbours and mean distance between a crystal and the one rebuilt from its key, by xi and delta."""
    rows = T.crystals(spark, sf_dir).select("id", F.transform("vectors", lambda v: v.cast("array<double>")).alias("cell"), F.transform("coords", lambda x: x / T.DELTA).alias("fractions"), "labels")
    grid = spark.createDataFrame(pd.DataFrame(_GRID, columns=["xi", "delta"]), "xi double, delta int")
    # equal crystals are looked at once and count as often as they stand there
    alike = rows.groupBy("cell", "fractions", "labels").agg(F.count("*").alias("crystals"))
    alike = written(alike.withColumn("id", F.monotonically_increasing_id()), "crystals")
    found = canonical.resolution_rows(alike.crossJoin(F.broadcast(grid))).join(alike.select("id", "crystals"), "id")  # four resolutions
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("crystals")) / F.sum("crystals"), 4).alias(c)
    return found.groupBy("xi", "delta").agg(F.sum("crystals").alias("n"), mean("neighbours"), mean("pdd"))
