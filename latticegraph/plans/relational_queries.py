"""Queries of scans, joins, aggregates, windows, sets and changes of the store that DuckDB can express as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, filters, lattice, matrices
from ..operators import search, store, sublattice
from ..sources import tables as T
from . import crystal_queries, store_queries
from .crystal_queries import _ATOMS
from .store_queries import _CLASS, _EDGE, _KEYS, _LATTICE, _MASK, _NODE, _PAIR, _POINT, _conorms, _keys, undirected

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


_STATUS = "status AS (SELECT user_id AS id, arg_max(CASE WHEN event_type = 'click' THEN 'CLOSED' ELSE 'OPEN' END, event_id) AS status FROM events GROUP BY 1)"
_END = "ends AS (SELECT s_suppkey AS id FROM supplier)"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status of every user of the events."""
    status = F.when(F.col("event_type") == "click", "CLOSED").otherwise("OPEN")
    return T.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by(status, "event_id").alias("status"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


# ---------------------------------------------------------------- scans and filters


@query("f1_explored_points", f"WITH {_POINT} SELECT id, energy, status = 'CLOSED' AS explored FROM point WHERE status IS NOT NULL")
def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).filter("status is not null").select("id", "energy", (F.col("status") == "CLOSED").alias("explored"))


@query("f2_point_ids", f"WITH {_POINT} SELECT id FROM point")
def ids_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).select("id")


@query("f3_point_by_id", f"WITH {_POINT} SELECT id, status, energy FROM point WHERE id = 7")
def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).filter("id = 7").select("id", "status", "energy")


_SQUARED = f"""p AS (SELECT i.id, i.k AS i, j.k AS j, [j.f[1] - i.f[1], j.f[2] - i.f[2], j.f[3] - i.f[3]] AS f FROM atom i JOIN atom j ON i.id = j.id AND i.k < j.k),
n AS (SELECT p.id, i, j, list_transform(range(1, 4), lambda k: (f[1] + {T.DELTA} * x) * a[k] + (f[2] + {T.DELTA} * y) * b[k] + (f[3] + {T.DELTA} * z) * c[k]) AS w
  FROM p JOIN lat USING (id), range(-1, 2) s(x), range(-1, 2) t(y), range(-1, 2) u(z)),
sq AS (SELECT id, i, j, min(w[1] * w[1] + w[2] * w[2] + w[3] * w[3])::BIGINT AS squared FROM n GROUP BY ALL)"""


@query("f9_filter_set", f"""WITH {_LATTICE}, {_ATOMS}, {_SQUARED}, near AS (SELECT id, min(squared) AS near FROM sq GROUP BY id)
SELECT lat.id, abs(a[1] * b[2] * c[3])::BIGINT AS volume, near FROM lat LEFT JOIN near USING (id) JOIN part ON p_partkey = lat.id
WHERE abs(a[1] * b[2] * c[3]) > 40 AND abs(a[1] * b[2] * c[3]) < 200 AND (near IS NULL OR near > 300) AND p_retailprice < 1400""")
def filter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crystals whose volume, distances and energy pass; all bounds are exclusive."""
    near = crystal_queries.pair_distances(spark, sf_dir).groupBy("id").agg(F.min("squared").alias("near"))
    rows = store_queries.volumes(spark, sf_dir).join(T.nodes(spark, sf_dir), "id").join(near, "id", "left")
    distances = F.when(F.col("near").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("near"))
    passes = filters.all_of(filters.volume_between(F.col("volume"), 40, 200), filters.energy_below(F.col("energy"), 1400), filters.distances_above(distances, 300))
    return rows.filter(passes).select("id", "volume", "near")


@query("f12_energy_filter", f"WITH {_EDGE}, {_NODE} SELECT DISTINCT src, dst FROM edge JOIN node ON dst = id WHERE energy < 1000")
def energy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours strictly below a ceiling, with the energies that are stored."""
    low = T.nodes(spark, sf_dir).filter(filters.energy_below(F.col("energy"), 1000)).select(F.col("id").alias("dst"))
    return T.edges(spark, sf_dir).distinct().join(low, "dst", "left_semi").select("src", "dst")


@query("f17_step_validation", f"""WITH {_LATTICE}, m AS (SELECT id, v, d, {_MASK} AS mask FROM con), f AS (SELECT id, v[1] + v[2] + v[3] + v[4] = v[5] + v[6] + v[7] AS superbasis, list_max(d) <= 0 AS obtuse,
bit_count(mask) <= 3 AND mask NOT IN (7, 25, 42, 52) AS possible FROM m) SELECT *, superbasis AND obtuse AND possible AS valid FROM f""")
def step_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the three conditions of a valid step, and all of them."""
    mask = lattice.zero_mask(F.col("d"))
    rows = _conorms(spark, sf_dir).select("id", lattice.is_superbasis(F.col("v")).alias("superbasis"), lattice.is_obtuse(F.col("d")).alias("obtuse"), mask.isin(lattice.possible_masks()).alias("possible"))
    return rows.withColumn("valid", F.col("superbasis") & F.col("obtuse") & F.col("possible"))


# ---------------------------------------------------------------- joins


@query("j4_end_points", f"WITH {_POINT}, {_END} SELECT ends.id, status, energy FROM ends LEFT JOIN point USING (id)")
def search_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(spark, sf_dir).join(T.points(spark, sf_dir).select("id", "status", "energy"), "id", "left")


@query("j5_searched_points", f"WITH {_POINT}, {_STATUS} SELECT s.id, p.energy FROM status s LEFT JOIN point p ON s.id = p.id WHERE s.status = 'CLOSED'")
def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status_points(_status(spark, sf_dir), T.points(spark, sf_dir), "CLOSED")


@query("j6_frontier_points", f"WITH {_POINT}, {_STATUS} SELECT s.id, p.energy FROM status s LEFT JOIN point p ON s.id = p.id WHERE s.status = 'OPEN'")
def frontier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status_points(_status(spark, sf_dir), T.points(spark, sf_dir), "OPEN")


@query("j7_frontier_under_ceiling", f"WITH {_POINT}, {_STATUS} SELECT s.id, p.energy FROM status s JOIN point p ON s.id = p.id WHERE s.status = 'OPEN' AND p.energy <= 150000 ORDER BY p.energy, s.id LIMIT 50")
def frontier_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.status_points(_status(spark, sf_dir), T.points(spark, sf_dir), "OPEN", stored_only=True)
    return rows.filter("energy <= 150000").orderBy("energy", "id").limit(50)


@query("j9_searched_among", f"WITH {_POINT} SELECT id FROM point WHERE status = 'CLOSED' AND id IN (SELECT l_suppkey FROM lineitem)")
def searched_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.edges(spark, sf_dir).select(F.col("dst").alias("id")).distinct()
    return T.points(spark, sf_dir).filter("status = 'CLOSED'").select("id").join(wanted, "id", "left_semi")


@query("j11_unseen_neighbours", f"WITH {_PAIR}, {_STATUS} SELECT pair.id, nb FROM pair WHERE nb NOT IN (SELECT id FROM status)")
def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _status(spark, sf_dir).select(F.col("id").alias("nb"))
    return undirected(spark, sf_dir).join(seen, "nb", "left_anti").select("id", "nb")


@query("j12_catalog_lookup", f"""WITH {_LATTICE}, m AS (SELECT id, {_MASK} AS mask FROM con WHERE list_max(d) <= 0)
SELECT id, mask, CASE {_CLASS.format('mask')} WHEN 1 THEN 24 WHEN 2 THEN 48 WHEN 3 THEN 72 WHEN 4 THEN 72 WHEN 5 THEN 96 END AS n_perms FROM m""")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conorms(spark, sf_dir).filter(lattice.is_obtuse(F.col("d"))).select("id", lattice.zero_mask(F.col("d")).alias("mask"))
    return rows.join(F.broadcast(lattice.catalog(spark)), "mask").select("id", "mask", F.size("perms").alias("n_perms"))


_HERMITE = """h AS (SELECT [[a, d, e], [0, b, f], [0, 0, 2 // (a * b)]] AS m FROM range(1, 3) x(a), range(1, 3) y(b), range(0, 2) u(d), range(0, 2) v(e), range(0, 2) w(f)
 WHERE 2 % (a * b) = 0 AND d < a AND e < a AND f < b)"""


@query("j14_matrix_products", f"""WITH {_HERMITE}, i AS (SELECT p_partkey AS id, p_size % 4 + 1 AS n FROM part),
x AS (SELECT id, [[a, d, e], [0, b, f], [0, 0, n // (a * b)]] AS x FROM i, range(1, 5) x(a), range(1, 5) y(b), range(0, 4) u(d), range(0, 4) v(e), range(0, 4) w(f) WHERE n % (a * b) = 0 AND d < a AND e < a AND f < b),
q AS (SELECT id, x, m AS y FROM x, h)
SELECT DISTINCT id, array_to_string(flatten(list_transform([1, 2, 3], lambda i: list_transform([1, 2, 3], lambda j: (x[i][1] * y[1][j] + x[i][2] * y[2][j] + x[i][3] * y[3][j])::BIGINT))), ' ') AS matrix FROM q""")
def matrix_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct products of every sublattice matrix of a part's index with those of index two."""
    matrix = F.expr("array(array(bigint(a), bigint(d), bigint(e)), array(0L, bigint(b), bigint(f)), array(0L, 0L, bigint(c)))")
    # the determinant of a product tells the index, so the products of one id under two of them are never equal
    rows = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).alias("n"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "n").distinct()
    second = sublattice.hermite_matrices(spark, 2).select(matrix.alias("y"))
    both = sublattice.sublattices(rows.select("n").distinct(), "n").select("n", matrix.alias("x")).crossJoin(F.broadcast(second))  # seven matrices
    flat = F.flatten(matrices.product(F.col("x"), F.col("y")))
    made = both.select("n", F.array_join(F.transform(flat, lambda x: x.cast("string")), " ").alias("matrix"))
    made = made.groupBy("n").agg(F.collect_set("matrix").alias("made"))  # a row for each of four indices
    return rows.join(F.broadcast(made), "n").select("id", F.explode("made").alias("matrix"))


@query("j16_nearest_end_pair", f"""WITH {_LATTICE}, {_EDGE}, p AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst),
q AS (SELECT src AS first, dst AS last, list_sum(list_transform(range(1, 8), lambda j: abs(s.v[j] - g.v[j])))::BIGINT AS apart FROM p JOIN con s ON s.id = src JOIN con g ON g.id = dst)
SELECT first, last, apart FROM q QUALIFY row_number() OVER (PARTITION BY first ORDER BY apart, last) = 1""")
def nearest_end_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the start of every search (the source of edges) the nearest of its goals (their ends), by vonorms."""
    keys = _conorms(spark, sf_dir).select("id", "v")
    # repeated pairs do not change a least one, so they need no hash table; adaptive execution would join the partitions
    pairs = T.edges(spark, sf_dir).filter("src <> dst").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src")
    pairs = pairs.join(keys.toDF("src", "a"), "src").join(keys.toDF("dst", "b"), "dst").select("src", "dst", distance.manhattan(F.col("a"), F.col("b"), 1).alias("apart"))
    return pairs.groupBy(F.col("src").alias("first")).agg(F.min(F.struct("apart", "dst")).alias("p")).select("first", F.col("p.dst").alias("last"), "p.apart")


@query("v12_end_point_check", f"""WITH {_EDGE}, {_STATUS}, {_END}, t AS (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge), g AS (SELECT id, count(*) AS degree FROM t GROUP BY id)
SELECT ends.id, coalesce(status = 'OPEN', false) AS in_frontier, coalesce(status = 'CLOSED', false) AS searched, coalesce(degree, 0) AS degree, coalesce(status = 'OPEN', false) OR coalesce(degree, 0) > 0 AS reached
FROM ends LEFT JOIN status USING (id) LEFT JOIN g USING (id)""")
def end_point_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.end_point_report(_ends(spark, sf_dir), _status(spark, sf_dir), T.edges(spark, sf_dir))


# ---------------------------------------------------------------- aggregates


@query("a1_counts", f"WITH {_POINT} SELECT count(*) AS n_points, count(energy) AS n_energy, count(*) FILTER (status = 'CLOSED') AS n_explored, min(energy) AS low, max(energy) AS high, (SELECT count(*) FROM lineitem) AS n_edges FROM point")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.points(spark, sf_dir).agg(F.count("*").alias("n_points"), F.count("energy").alias("n_energy"), F.count_if(F.col("status") == "CLOSED").alias("n_explored"), F.min("energy").alias("low"), F.max("energy").alias("high"))
    return rows.crossJoin(T.edges(spark, sf_dir).agg(F.count("*").alias("n_edges")))


@query("a6_search_statistics", f"WITH {_POINT} SELECT search, count(*) FILTER (status = 'OPEN') AS frontier, count(*) FILTER (status = 'CLOSED') AS searched, max(energy) FILTER (status = 'CLOSED') AS high_water FROM point GROUP BY search")
def search_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(T.points(spark, sf_dir)).select("search", F.col("n_open").alias("frontier"), F.col("n_closed").alias("searched"), "high_water")


_BUCKETS = "g AS (SELECT id % 8 AS bucket, count(*) AS n_points, count(energy) AS n_energy, min(energy) AS min_energy, max(energy) AS max_energy, count(*) FILTER (status = 'OPEN') AS n_open, count(*) FILTER (status = 'CLOSED') AS n_closed, max(energy) FILTER (status = 'CLOSED') AS high_water, min(energy) FILTER (status = 'OPEN') AS water_level FROM point GROUP BY 1)"


@query("a9_partition_statistics", f"WITH {_POINT}, {_BUCKETS} SELECT * FROM g")
def partition_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bounded_statistics(T.points(spark, sf_dir), 8)


@query("a11_spread_over_partitions", f"WITH {_POINT}, {_BUCKETS} SELECT round(avg(n_points), 6) AS mean, median(n_points)::DOUBLE AS median, max(n_points) AS most FROM g")
def spread_over_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_statistics(spark, sf_dir).agg(F.round(F.avg("n_points"), 6).alias("mean"), F.median("n_points").alias("median"), F.max("n_points").alias("most"))


@query("a12_rates", "WITH g AS (SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, n, CASE WHEN last > first THEN round((n - 1) * 1e6::DOUBLE / (epoch_us(last) - epoch_us(first)), 9) END AS per_second FROM g")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters a second between the first and the last of a user; null for one moment."""
    rows = T.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    apart = F.expr("timestampdiff(MICROSECOND, first, last)")
    return rows.select("user_id", "n", F.when(apart > 0, F.round((F.col("n") - 1) * F.lit(1e6) / apart, 9)).alias("per_second"))


@query("a15_success_rates", "SELECT c_custkey AS search, round(coalesce(avg((o_orderstatus = 'F')::INT), 0), 6) AS rate FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of found attempts; zero for a search without any."""
    done = T.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("search")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))
    every = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("search"))
    return every.join(done, "search", "left").select("search", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"))


@query("a18_shortest_bonds", f"WITH {_LATTICE}, {_ATOMS}, {_SQUARED} SELECT (id % 3 + 1)::INT AS n_atoms, min(squared) AS shortest FROM sq GROUP BY 1")
def shortest_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crystal_queries.pair_distances(spark, sf_dir)
    return rows.groupBy((F.col("id") % 3 + 1).cast("int").alias("n_atoms")).agg(F.min("squared").alias("shortest"))


@query("a19_lowest_neighbours", f"WITH {_EDGE}, {_NODE} SELECT src, arg_min(dst, (energy, dst)) AS dst, min(energy) AS energy FROM edge JOIN node ON dst = id GROUP BY src")
def lowest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lowest_neighbour(T.edges(spark, sf_dir), T.nodes(spark, sf_dir))


@query("a20_ring_counts", f"""WITH RECURSIVE {_PAIR}, r AS (SELECT 0::BIGINT AS id, 0 AS ring UNION SELECT nb, ring + 1 FROM r JOIN pair USING (id) WHERE ring < 3),
g AS (SELECT id, min(ring)::INT AS ring FROM r GROUP BY id) SELECT ring, count(*) AS n FROM g GROUP BY ring""")
def ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rings(undirected(spark, sf_dir), spark.range(1), 3).groupBy("ring").agg(F.count("*").alias("n"))


_PERMS = "perm AS (SELECT unnest([" + ", ".join(str(list(p)) for p in lattice.automorphisms()) + "]) AS p)"


@query("a22_primary_sets", f"""WITH {_PERMS}, k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS n FROM perm)
SELECT array_to_string(list_sort(p[1:4]), ' ') AS places, count(*) AS n FROM part JOIN k ON k.n = p_partkey % 168 GROUP BY 1""")
def primary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the four conorms that come first in the permutation of their number modulo 168."""
    every = spark.createDataFrame([(k, list(p)) for k, p in enumerate(lattice.automorphisms())], "k int, p array<int>")
    rows = T.read(spark, sf_dir, "part").select((F.col("p_partkey") % 168).cast("int").alias("k")).join(F.broadcast(every), "k")  # 168 rows
    places = F.array_join(F.transform(matrices.primary_set(F.col("p")), lambda x: x.cast("string")), " ")
    return rows.groupBy(places.alias("places")).agg(F.count("*").alias("n"))


@query("a24_element_counts", f"WITH {_ATOMS} SELECT id, count(*) AS n, count(*) FILTER (label = 0) AS n_origin, count(DISTINCT label) AS n_elements FROM atom GROUP BY id")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return T.crystals(spark, sf_dir).select("id", size("labels").alias("n"), size(F.filter("labels", lambda x: x == 0)).alias("n_origin"), size(F.array_distinct("labels")).alias("n_elements"))


# ---------------------------------------------------------------- windows and order


@query("w5_run_numbers", """WITH s AS (SELECT l_orderkey AS path, l_linenumber AS n, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
c AS (SELECT *, (lag(f) OVER (PARTITION BY path ORDER BY n) <> f)::INT AS changed FROM s) SELECT path, n, coalesce(sum(changed) OVER (PARTITION BY path ORDER BY n), 0)::BIGINT AS run FROM c""")
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("f"))
    w = Window.partitionBy("path").orderBy("n")
    changed = F.coalesce((F.lag("f").over(w) != F.col("f")).cast("int"), F.lit(0))
    return rows.withColumn("changed", changed).select("path", "n", F.sum("changed").over(w).alias("run"))


@query("w6_first_per_key", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.struct("event_id", "value"), "event_id").alias("r")
    return T.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", "r.*")


@query("o2_inbox_in_order", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select("event_id", "user_id").orderBy("event_id").limit(1000)


@query("o5_sorted_atoms", f"WITH {_ATOMS} SELECT id, string_agg(label || ':' || f[1] || ',' || f[2] || ',' || f[3], ' ' ORDER BY label, f) AS atoms FROM atom GROUP BY id")
def sorted_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.crystals(spark, sf_dir).select("id", matrices.sorted_atoms(F.col("labels"), matrices.atoms(F.col("coords"))).alias("atoms"))
    return rows.select("id", F.expr("array_join(transform(atoms, x -> concat(x.label, ':', array_join(transform(x.at, c -> string(c)), ','))), ' ')").alias("atoms"))


@query("o8_beam", f"WITH {_POINT} SELECT id, energy + id % 100 AS f, id % 100 AS h FROM point WHERE status = 'OPEN' AND energy IS NOT NULL ORDER BY f, h, id LIMIT 200")
def beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open points that a beam of 200 keeps."""
    rows = T.points(spark, sf_dir).filter("status = 'OPEN' and energy is not null").withColumn("h", F.col("id") % 100)
    return rows.select("id", (F.col("energy") + F.col("h")).alias("f"), "h").orderBy("f", "h", "id").limit(200)


# ---------------------------------------------------------------- sets and changes


@query("e1_union", f"WITH {_EDGE} SELECT src AS id FROM edge UNION SELECT dst FROM edge")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.edges(spark, sf_dir)
    return rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()


@query("e2_ends_in_frontier", f"WITH {_END}, {_POINT} SELECT id FROM ends INTERSECT SELECT id FROM point WHERE status = 'OPEN'")
def ends_in_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(spark, sf_dir).intersect(T.points(spark, sf_dir).filter("status = 'OPEN'").select("id"))


@query("e5_without_loops", f"WITH {_EDGE} SELECT DISTINCT src, dst FROM edge WHERE src <> dst")
def without_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(spark, sf_dir).filter("src <> dst").distinct()


@query("u2_deleted_points", f"WITH {_POINT}, {_END} SELECT id, energy FROM point WHERE id NOT IN (SELECT id FROM ends)")
def deleted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(T.points(spark, sf_dir).select("id", "energy"), _ends(spark, sf_dir), ["id"])


_ROUTE = "route AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders)"


@query("u3_added_edges", f"WITH {_EDGE}, {_ROUTE}, a AS (SELECT src, dst FROM edge UNION ALL SELECT src, dst FROM route UNION ALL SELECT dst, src FROM route) SELECT src, count(*) AS n FROM a GROUP BY src")
def added_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of edges that leave each point after others were added in both directions."""
    new = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return store.add_edges(T.edges(spark, sf_dir), new).groupBy("src").agg(F.count("*").alias("n"))


@query("u4_deleted_edges", f"WITH {_EDGE}, gone AS (SELECT src, dst FROM edge WHERE dst % 5 = 0), b AS (SELECT src, dst FROM gone UNION SELECT dst, src FROM gone) SELECT src, dst, count(*) AS n FROM edge WHERE (src, dst) NOT IN (SELECT (src, dst) FROM b) GROUP BY ALL")
def deleted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = T.edges(spark, sf_dir)
    w = Window.partitionBy("src", "dst").orderBy("src")  # equal edges are counted in their order, which needs no hash table
    left = store.delete_edges(edges, edges.filter("dst % 5 = 0")).select("src", "dst", F.row_number().over(w).cast("long").alias("n"), F.lead(F.lit(1)).over(w).alias("more"))
    return left.filter("more is null").drop("more")


@query("u5_set_energies", f"WITH {_POINT}, {_NODE} SELECT p.id, coalesce(n.energy, p.energy) AS energy FROM point p LEFT JOIN node n USING (id)")
def set_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.set_values(T.points(spark, sf_dir).select("id", "energy"), T.nodes(spark, sf_dir), "id", "energy")


@query("u7_changed_status", f"WITH {_POINT}, {_END} SELECT id, CASE WHEN id IN (SELECT id FROM ends) THEN 'OPEN' ELSE status END AS status FROM point WHERE status IS NOT NULL")
def changed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses after the end points were set open; points without a status have none to change."""
    rows = T.points(spark, sf_dir).filter("status is not null").select("id", "status")
    return store.set_values(rows, _ends(spark, sf_dir).withColumn("status", F.lit("OPEN")), "id", "status")


@query("u9_inbox_left", "SELECT user_id, count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id LIMIT 1000) GROUP BY 1")
def inbox_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each user that are left after the first thousand of all were taken."""
    letters = T.read(spark, sf_dir, "events").select("event_id", "user_id")
    return store.delete(letters, inbox(spark, sf_dir), ["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))
