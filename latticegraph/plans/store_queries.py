"""Queries of the store, search and lattice operators over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, lattice
from ..operators import search, store, sublattice
from ..sources import bucketed
from ..sources import tables as T
from ..storage import shared_dir, written
from ..streaming import mailbox

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_POINT = """point AS (SELECT o_orderkey AS id, o_custkey % 3 AS search, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' END AS status,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS energy FROM orders)"""
_EDGE = "edge AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
_PAIR = f"{_EDGE}, pair AS (SELECT src AS id, dst AS nb FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst)"
_NODE = "node AS (SELECT p_partkey AS id, p_retailprice AS energy FROM part)"
_LATTICE = """lat AS (SELECT p_partkey AS id, [p_partkey % 5 + 3, 0, 0] AS a, [p_partkey % 3 - 1, floor(p_partkey / 5.0)::BIGINT % 5 + 3, 0] AS b,
  [p_size % 3 - 1, (p_partkey + p_size) % 3 - 1, p_size % 5 + 3]::BIGINT[] AS c FROM part),
basis AS (SELECT id, a, b, c, [-(a[1] + b[1] + c[1]), -(a[2] + b[2] + c[2]), -(a[3] + b[3] + c[3])] AS e FROM lat),
von AS (SELECT id, list_transform([a, b, c, e, list_transform(range(1, 4), lambda k: a[k] + b[k]), list_transform(range(1, 4), lambda k: a[k] + c[k]),
  list_transform(range(1, 4), lambda k: a[k] + e[k])], lambda w: (w[1] * w[1] + w[2] * w[2] + w[3] * w[3])::BIGINT) AS v FROM basis),
con AS (SELECT id, v, [v[5] - v[1] - v[2], v[6] - v[1] - v[3], v[7] - v[1] - v[4], v[7] - v[2] - v[3], v[6] - v[2] - v[4], v[5] - v[3] - v[4]] AS d FROM von)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# ---------------------------------------------------------------- lattices


def _conorms(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = lattice.superbasis(F.col("vectors"))
    return T.lattices(spark, sf_dir).select("id", "vectors", lattice.vonorms(basis).alias("v"), lattice.basis_conorms(basis).alias("d"))


_MASK = "list_sum(list_transform(range(1, 7), lambda k: CASE WHEN d[k] = 0 THEN 1 << (k - 1)::INT ELSE 0 END))::INT"
_CLASS = "CASE bit_count({0}) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 5 WHEN 2 THEN CASE WHEN {0} IN (33, 18, 12) THEN 3 ELSE 4 END END"


@query("x2_vonorms", f"WITH {_LATTICE} SELECT id, v[1] AS v0, v[2] AS v1, v[3] AS v2, v[4] AS v3, v[5] AS v01, v[6] AS v02, v[7] AS v03 FROM von")
def vonorm_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conorms(spark, sf_dir).select("id", *(F.col("v")[k].alias(n) for k, n in enumerate("v0 v1 v2 v3 v01 v02 v03".split())))


@query("x3_conorms", f"WITH {_LATTICE} SELECT id, d[1] AS d01, d[2] AS d02, d[3] AS d03, d[4] AS d12, d[5] AS d13, d[6] AS d23, v[1] + v[2] + v[3] + v[4] = v[5] + v[6] + v[7] AS is_superbasis, list_max(d) <= 0 AS is_obtuse FROM con")
def conorm_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, v = F.col("d"), F.col("v")
    return _conorms(spark, sf_dir).select("id", *(d[k].alias(f"d{i}{j}") for k, (i, j) in enumerate(lattice.PAIRS)), lattice.is_superbasis(v).alias("is_superbasis"), lattice.is_obtuse(d).alias("is_obtuse"))


@query("x5_voronoi_class", f"WITH {_LATTICE}, m AS (SELECT id, {_MASK} AS mask FROM con WHERE list_max(d) <= 0) SELECT id, mask, {_CLASS.format('mask')} AS voronoi FROM m")
def voronoi_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conorms(spark, sf_dir).filter(lattice.is_obtuse(F.col("d"))).select("id", lattice.zero_mask(F.col("d")).alias("mask"))
    return rows.withColumn("voronoi", lattice.voronoi_class(F.col("mask")))


@query("x22_volume", f"WITH {_LATTICE} SELECT id, abs(a[1] * (b[2] * c[3] - b[3] * c[2]) - a[2] * (b[1] * c[3] - b[3] * c[1]) + a[3] * (b[1] * c[2] - b[2] * c[1]))::BIGINT AS volume FROM lat")
def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lattices(spark, sf_dir).select("id", F.abs(lattice.determinant(F.col("vectors"))).alias("volume"))


@query("f10_volume_filter", f"WITH {_LATTICE}, v AS (SELECT id, abs(a[1] * b[2] * c[3])::BIGINT AS volume FROM lat), r AS (SELECT min(volume) AS lo, max(volume) AS hi FROM v) SELECT id, volume FROM v, r WHERE volume * 5 > lo * 8 AND volume * 10 < hi * 8")
def volume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes strictly between 1.6 times the least and 0.8 times the greatest."""
    rows = volumes(spark, sf_dir)
    bounds = rows.agg(F.min("volume").alias("lo"), F.max("volume").alias("hi"))
    return rows.join(F.broadcast(bounds), (F.col("volume") * 5 > F.col("lo") * 8) & (F.col("volume") * 10 < F.col("hi") * 8)).select("id", "volume")


_SELLING = "CASE list_position(d, list_max(d)) " + " ".join(f"WHEN {p + 1} THEN [" + ", ".join(" + ".join(("-" if t < 0 else "") + f"d[{abs(t)}]" for t in ts) for ts in lattice.selling_step_places(p)) + "]" for p in range(6)) + " END"
_REDUCED = f"red AS (SELECT id, d FROM con UNION ALL SELECT id, {_SELLING} FROM red WHERE list_max(d) > 0), fin AS (SELECT id, d, {_MASK} AS mask FROM red WHERE list_max(d) <= 0)"


@query("k1_selling_reduction", f"WITH RECURSIVE {_LATTICE}, {_REDUCED} SELECT id, d[1] AS d01, d[2] AS d02, d[3] AS d03, d[4] AS d12, d[5] AS d13, d[6] AS d23, mask FROM fin")
def selling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conorms(spark, sf_dir).select("id", lattice.selling_reduce(F.col("d")).alias("d"))
    return rows.select("id", *(F.col("d")[k].alias(f"d{i}{j}") for k, (i, j) in enumerate(lattice.PAIRS)), lattice.zero_mask(F.col("d")).alias("mask"))


def _lnf_sql() -> str:
    perms = "[" + ", ".join(str(list(p)) for p in lattice.automorphisms()) + "]"
    image = "[" + ", ".join("(-(" + " + ".join(f"s[p[{k + 1}] + 1]" for k in sup) + ") // 2)::BIGINT" for sup in lattice.SUPPORT) + "]"
    return f"""WITH RECURSIVE {_LATTICE}, {_REDUCED}, perm AS (SELECT unnest({perms}) AS p), cand AS (
  SELECT id, mask, {image} AS w FROM (SELECT id, mask, list_append(d, 0) AS s FROM fin), perm WHERE s[p[7] + 1] = 0),
  best AS (SELECT id, mask, min(w) AS w FROM cand GROUP BY id, mask)
SELECT id, {_CLASS.format('mask')} AS voronoi, array_to_string(w, ' ') AS lnf FROM best"""


@query("k5_lattice_form", _lnf_sql())
def lattice_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lattice.lattice_forms(T.lattices(spark, sf_dir))
    return rows.select("id", "voronoi", F.array_join(F.transform("lnf", lambda x: x.cast("string")), " ").alias("lnf"))


@query("k5_sheared_form", _lnf_sql())
def sheared_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every lattice, found from a basis sheared by up to ten thousand; the SQL knows no shear."""
    a, b, c = (F.col("vectors")[k] for k in range(3))
    s, t = F.pmod(F.col("id") * 7919, F.lit(20_001)) - 10_000, F.pmod(F.col("id") * 31, F.lit(201)) - 100
    plus = lambda x, k, y: F.zip_with(x, y, lambda p, q: p + q * k)
    rows = T.lattices(spark, sf_dir).select("id", a.alias("a"), plus(b, s, a).alias("b"), plus(c, t, b).alias("c"))
    rows = lattice.lattice_forms(rows.select("id", F.array("a", "b", "c").alias("vectors")))
    return rows.select("id", "voronoi", F.array_join(F.transform("lnf", lambda x: x.cast("string")), " ").alias("lnf"))


_STEPS = "[" + ", ".join(str(list(s)) for s in lattice.step_vectors()) + "]"


@query("k16_step_candidates", f"""WITH {_LATTICE}, s AS (SELECT unnest({_STEPS}) AS s),
n AS (SELECT id, list_transform(range(1, 8), lambda k: v[k] + s[k]) AS v FROM con, s WHERE list_max(d) <= 0),
e AS (SELECT DISTINCT id, v, [v[5] - v[1] - v[2], v[6] - v[1] - v[3], v[7] - v[1] - v[4], v[7] - v[2] - v[3], v[6] - v[2] - v[4], v[5] - v[3] - v[4]] AS d FROM n),
m AS (SELECT id, {_MASK} AS mask FROM e WHERE list_max(d) <= 0 AND v[1] + v[2] + v[3] + v[4] = v[5] + v[6] + v[7])
SELECT {_CLASS.format('mask')} AS voronoi, count(*) AS n FROM m WHERE bit_count(mask) <= 3 AND mask NOT IN (7, 25, 42, 52) GROUP BY 1""")
def step_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved vonorm lists of obtuse lattices that are obtuse superbases themselves, counted by Voronoi class."""
    rows = _conorms(spark, sf_dir).filter(lattice.is_obtuse(F.col("d"))).select("id", "v")
    # ids with the same lists go together, and the lists of an id are told apart in its row
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id").agg(F.sort_array(F.collect_set("v")).alias("vs"))
    alike = rows.groupBy("vs").agg(F.count("*").alias("ids"))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in lattice.step_vectors()))
    moved = F.flatten(F.transform("vs", lambda v: F.transform(steps, lambda s: F.zip_with(v, s, lambda a, b: a + b))))
    moved = alike.select("ids", F.explode(F.array_distinct(moved)).alias("v"))
    moved = moved.filter(lattice.is_superbasis(F.col("v"))).withColumn("d", lattice.doubled_conorms(F.col("v"))).filter(lattice.is_obtuse(F.col("d")))
    moved = moved.withColumn("mask", lattice.zero_mask(F.col("d"))).filter(F.col("mask").isin(lattice.possible_masks()))
    return moved.groupBy(lattice.voronoi_class(F.col("mask")).alias("voronoi")).agg(F.sum("ids").alias("n"))


@query("k29_catalog_summary", f"""WITH {_LATTICE}, m AS (SELECT {_MASK} AS mask FROM con WHERE list_max(d) <= 0), c AS (SELECT {_CLASS.format('mask')} AS voronoi FROM m)
SELECT voronoi, count(*) AS n, CASE voronoi WHEN 1 THEN 24 WHEN 2 THEN 48 WHEN 5 THEN 96 ELSE 72 END AS n_perms FROM c GROUP BY voronoi""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obtuse lattices by Voronoi class, and how many permutations the catalog permits them."""
    entries = lattice.catalog(spark).select("mask", F.size("perms").alias("n_perms"))  # one row for each zero set
    return voronoi_classes(spark, sf_dir).join(F.broadcast(entries), "mask").groupBy("voronoi").agg(F.count("*").alias("n"), F.max("n_perms").alias("n_perms"))


@query("k21_sublattices", """SELECT p_partkey AS id, a::INT AS a, b::INT AS b, (n // (a * b))::INT AS c, d::INT AS d, e::INT AS e, f::INT AS f
FROM (SELECT p_partkey, p_size % 6 + 1 AS n FROM part), range(1, 7) x(a), range(1, 7) y(b), range(0, 6) u(d), range(0, 6) w(e), range(0, 6) z(f)
WHERE n % (a * b) = 0 AND d < a AND e < a AND f < b""")
def sublattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sublattice of every part's lattice, of an index of one to six that its size gives."""
    rows = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6 + 1).alias("n"))
    return sublattice.sublattices(rows, "n").drop("n")


@query("f7_energy_ceiling", f"WITH {_POINT} SELECT id, energy FROM point WHERE status = 'OPEN' AND energy <= 100000")
def energy_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).filter("status = 'OPEN' and energy <= 100000").select("id", "energy")


@query("j1_neighbours", f"WITH {_PAIR} SELECT id, nb FROM pair")
def undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.neighbours(T.edges(spark, sf_dir))


@query("s10_bucketed_store", f"WITH {_PAIR}, {_POINT} SELECT id, nb, status FROM pair LEFT JOIN point USING (id)")
def bucketed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every point and its status, joined bucket by bucket over a store of bucketed tables."""
    name = f"points_{uuid.uuid4().hex}"
    points = T.points(spark, sf_dir)
    held = bucketed.BucketedStore.create(spark, name, points, T.edges(spark, sf_dir), points, buckets=16)
    try:
        return written(held.neighbours().join(held.table("status"), "id", "left").select("id", "nb", "status"), "bucketed")
    finally:
        held.drop()


@query("g3_paths", """WITH RECURSIVE w AS (SELECT s_suppkey AS goal, 0 AS hop, s_suppkey AS id FROM supplier JOIN part ON p_partkey = s_suppkey
  UNION ALL SELECT goal, hop + 1, id - 1 - id % 3 FROM w JOIN part ON p_partkey = id WHERE id - 1 - id % 3 >= 1) SELECT goal, hop::INT AS hop, id FROM w WHERE id IN (SELECT p_partkey FROM part)""")
def paths_by_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the ways back from many ends at once, over links that lead one to three numbers down."""
    parent = F.col("id") - 1 - F.col("id") % 3
    links = T.nodes(spark, sf_dir).select("id").withColumn("parent", F.when(parent >= 1, parent))
    ends = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(links.select("id"), "id", "left_semi")
    return search.paths_to(links, ends).select("goal", "hop", "id")


@query("j2_neighbour_keys", f"WITH {_EDGE}, {_NODE} SELECT DISTINCT src, dst, energy FROM edge LEFT JOIN node ON dst = id")
def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.neighbour_keys(T.edges(spark, sf_dir), T.nodes(spark, sf_dir))


@query("j3_foreign_neighbours", f"WITH {_EDGE} SELECT DISTINCT src, dst FROM edge WHERE dst NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that lead out of the local partition (even keys)."""
    local = T.read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("dst"))
    return T.edges(spark, sf_dir).distinct().join(local, "dst", "left_anti").select("src", "dst")


@query("j10_new_frontier", f"WITH {_PAIR}, {_POINT} SELECT DISTINCT nb AS id FROM pair WHERE nb NOT IN (SELECT id FROM point WHERE status = 'CLOSED')")
def new_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = T.points(spark, sf_dir).filter("status = 'CLOSED'").select("id")
    return undirected(spark, sf_dir).select(F.col("nb").alias("id")).distinct().join(closed, "id", "left_anti")


@query("j8_membership", f"WITH {_EDGE}, {_POINT} SELECT DISTINCT src AS id FROM edge WHERE src IN (SELECT id FROM point WHERE status = 'OPEN')")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    frontier = T.points(spark, sf_dir).filter("status = 'OPEN'").select(F.col("id").alias("src"))
    return T.edges(spark, sf_dir).select("src").distinct().join(frontier, "src", "left_semi").withColumnRenamed("src", "id")


@query("f4_points_by_keys", f"WITH {_POINT}, w AS (SELECT s_suppkey AS pos, s_suppkey * 7 % 50 AS id FROM supplier) SELECT pos, id, search, status, energy FROM w JOIN point USING (id)")
def by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") * 7 % 50).alias("id"))
    return store.points_by_keys(T.points(spark, sf_dir), wanted).select("pos", "id", "search", "status", "energy")


@query("j18_bracket_lookup", """WITH c AS (SELECT l_orderkey AS path, l_linenumber AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ALL),
w AS (SELECT path, n, sum(q) OVER (PARTITION BY path ORDER BY n)::BIGINT AS cum FROM c),
t AS (SELECT path, max(cum) // 2 AS target FROM w GROUP BY path)
SELECT t.path, t.target, max(CASE WHEN cum <= target THEN n END) AS bracket FROM t JOIN w USING (path) GROUP BY ALL""")
def bracket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step of a path whose cumulative length does not pass half of the whole."""
    steps = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    w = Window.partitionBy("path").orderBy("n")
    rows = steps.select("path", "n", F.sum("q").over(w).alias("cum"), F.expr("sum(q) over (partition by path) div 2").alias("target"))
    return rows.groupBy("path", "target").agg(F.max(F.when(F.col("cum") <= F.col("target"), F.col("n"))).alias("bracket"))


# ---------------------------------------------------------------- aggregates, top-k, sets, upserts


@query("a3_statistics", f"""WITH {_POINT} SELECT search, count(*) AS n_points, count(energy) AS n_energy, min(energy) AS min_energy, max(energy) AS max_energy,
count(*) FILTER (status = 'OPEN') AS n_open, count(*) FILTER (status = 'CLOSED') AS n_closed, max(energy) FILTER (status = 'CLOSED') AS high_water,
min(energy) FILTER (status = 'OPEN') AS water_level FROM point GROUP BY search""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(T.points(spark, sf_dir))


@query("a8_global_level", f"WITH {_POINT} SELECT min(energy) AS level FROM point WHERE status = 'OPEN'")
def global_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).filter("status = 'OPEN'").agg(F.min("energy").alias("level"))


@query("a10_roll_up", f"WITH {_POINT} SELECT search, status, count(*) AS n, max(energy) AS top FROM point WHERE status IS NOT NULL GROUP BY ROLLUP (search, status)")
def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).filter("status is not null").rollup("search", "status").agg(F.count("*").alias("n"), F.max("energy").alias("top"))


@query("a13_path_barriers", "SELECT l_orderkey AS path, max(l_extendedprice) AS barrier, count(*) AS n_steps FROM lineitem GROUP BY 1")
def path_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.max("l_extendedprice").alias("barrier"), F.count("*").alias("n_steps"))


@query("a14_best_paths", """WITH b AS (SELECT l_orderkey AS path, max(l_extendedprice) AS barrier FROM lineitem GROUP BY 1)
SELECT o_custkey AS search, arg_min(path, (barrier, path)) AS path, min(barrier) AS barrier FROM b JOIN orders ON path = o_orderkey GROUP BY 1""")
def best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("search"))
    rows = path_barriers(spark, sf_dir).join(owner, "path")
    return rows.groupBy("search").agg(F.min_by("path", F.struct("barrier", "path")).alias("path"), F.min("barrier").alias("barrier"))


@query("a16_attempts", """WITH a AS (SELECT o_custkey AS c, o_orderstatus = 'F' AS found, o_orderkey % 1000 AS it FROM orders),
g AS (SELECT c, count(*) AS n, count(*) FILTER (found) AS n_found, max(it) AS most, list_sort(list(it)) AS l FROM a GROUP BY c)
SELECT c AS search, n, n_found, most, (CASE WHEN n % 2 = 1 THEN l[n // 2 + 1] ELSE (l[n // 2] + l[n // 2 + 1]) // 2 END)::BIGINT AS median FROM g""")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per search with the integer median of their iterations."""
    rows = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search"), (F.col("o_orderstatus") == "F").alias("found"), (F.col("o_orderkey") % 1000).alias("it"))
    grouped = rows.groupBy("search").agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), F.max("it").alias("most"), F.sort_array(F.collect_list("it")).alias("l"))
    median = F.expr("case when n % 2 = 1 then l[cast(n div 2 as int)] else (l[cast(n div 2 as int) - 1] + l[cast(n div 2 as int)]) div 2 end")
    return grouped.select("search", "n", "n_found", "most", median.alias("median"))


@query("o1_frontier", f"WITH {_POINT} SELECT search, id, energy, row_number() OVER (PARTITION BY search ORDER BY energy ASC NULLS FIRST, id)::INT AS rank FROM point WHERE status = 'OPEN' QUALIFY rank <= 500")
def frontier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.frontier(T.points(spark, sf_dir), 500).select("search", "id", "energy", "rank")


@query("o1_frontier_under_ceiling", f"WITH {_POINT} SELECT search, id, energy, row_number() OVER (PARTITION BY search ORDER BY energy, id)::INT AS rank FROM point WHERE status = 'OPEN' AND energy <= 90000 QUALIFY rank <= 100")
def frontier_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.frontier(T.points(spark, sf_dir), 100, 90000).select("search", "id", "energy", "rank")


@query("e3_end_points_reached", f"WITH {_POINT} SELECT s_suppkey AS id FROM supplier INTERSECT SELECT id FROM point WHERE status IS NOT NULL")
def end_points_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End points (the suppliers' numbers) that have a status."""
    ends = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return ends.intersect(T.points(spark, sf_dir).filter("status is not null").select("id"))


@query("e4_difference", f"WITH {_EDGE} SELECT dst AS id FROM edge EXCEPT SELECT src FROM edge")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.edges(spark, sf_dir)
    return rows.select(F.col("dst").alias("id")).subtract(rows.select("src"))


@query("u1_insert_missing", f"WITH {_POINT}, {_NODE} SELECT id, energy FROM point UNION ALL SELECT DISTINCT id, energy FROM node WHERE id NOT IN (SELECT id FROM point)")
def insert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_missing(T.points(spark, sf_dir).select("id", "energy"), T.nodes(spark, sf_dir), ["id"])


@query("u6_upsert_status", f"""WITH {_POINT}, u AS (SELECT user_id AS id, arg_max(CASE WHEN event_type = 'click' THEN 'CLOSED' ELSE 'OPEN' END, event_id) AS status FROM events GROUP BY 1)
SELECT coalesce(u.id, point.id) AS id, CASE WHEN u.id IS NULL THEN point.status ELSE u.status END AS status FROM point FULL JOIN u ON u.id = point.id""")
def upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "CLOSED").otherwise("OPEN")
    updates = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), status.alias("status"), F.col("event_id").alias("seq"))
    return store.upsert(T.points(spark, sf_dir).select("id", "status"), updates, ["id"], "seq")


# ---------------------------------------------------------------- windows, distances, keys, searches, streams


@query("w1_step_changes", """WITH s AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS n, l_partkey AS k, l_suppkey AS m FROM lineitem)
SELECT path, n, k, m, CASE WHEN lag(k) OVER w IS NULL THEN NULL WHEN lag(k) OVER w <> k THEN 'lattice' ELSE 'motif' END AS step FROM s WINDOW w AS (PARTITION BY path ORDER BY n, k, m)""")
def step_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("m")).distinct()
    before = F.lag("k").over(Window.partitionBy("path").orderBy("n", "k", "m"))
    return rows.withColumn("step", F.when(before.isNull(), None).when(before != F.col("k"), "lattice").otherwise("motif"))


_KEYS = "k AS (SELECT vec_id AS id, list_transform(embedding[1:8], lambda x: round_even(x * 100, 0)::BIGINT) AS key FROM embeddings)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 8), lambda x: F.rint(x * F.lit(100).cast("float")).cast("long")).alias("key"))


@query("x25_goal_distances", f"""WITH {_KEYS}, g AS (SELECT list(key) AS goals FROM k WHERE id < 5)
SELECT id, 2 * list_min(list_transform(goals, lambda g: list_sum(list_transform(range(1, 9), lambda j: abs(key[j] - g[j])))))::BIGINT AS manhattan,
list_min(list_transform(goals, lambda g: list_sum(list_transform(range(1, 9), lambda j: (key[j] - g[j]) * (key[j] - g[j])))))::BIGINT AS euclidean FROM k, g""")
def goal_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir)
    goals = rows.filter("id < 5").agg(F.collect_list("key").alias("goals"))  # the five goals of the search
    both = rows.crossJoin(F.broadcast(goals))
    return both.select("id", distance.nearest_goal(F.col("key"), F.col("goals")).alias("manhattan"), distance.nearest_goal(F.col("key"), F.col("goals"), distance.squared_euclidean).alias("euclidean"))


@query("s6_key_codec", f"WITH {_KEYS} SELECT id, '[' || array_to_string(key, ',') || ']' AS key_text, true AS round_trip FROM k")
def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir).withColumn("key_text", distance.key_text(F.col("key")))
    return rows.select("id", "key_text", (distance.parse_key(F.col("key_text")) == F.col("key")).alias("round_trip"))


@query("g16_rings", f"""WITH RECURSIVE {_PAIR}, r AS (SELECT 0::BIGINT AS id, 0 AS ring UNION SELECT nb, ring + 1 FROM r JOIN pair USING (id) WHERE ring < 3)
SELECT id, min(ring)::INT AS ring FROM r GROUP BY id""")
def breadth_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rings(undirected(spark, sf_dir), spark.range(1), 3)


@query("g6_flood")
def flooded(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, goal = spark.range(1), spark.range(1999, 2000)
    return search.flood(undirected(spark, sf_dir), T.nodes(spark, sf_dir), start, goal, width=20.0, batch=200, max_steps=6)


@query("m16_mailbox", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def mailbox_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mailbox as a stream with state: every key is taken once, with its first letter."""
    letters = spark.readStream.schema(T.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a file by a pattern only
    taken = mailbox.deliver(letters, "user_id", "event_id", f"{shared_dir(spark)}/mailbox-{uuid.uuid4().hex}")
    return taken.select(F.col("key").alias("user_id"), F.col("letter").alias("event_id"))


@query("m17_arrivals", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.arrivals_per_window(T.read(spark, sf_dir, "events"), "ts")
