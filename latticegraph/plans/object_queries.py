"""Queries of filters derived from ends, comparisons, rounding, element order and JSON, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements, filters, lattice, matrices
from ..operators import motifs
from ..sources import structures
from ..sources import tables as T
from . import crystal_queries, store_queries
from .crystal_queries import _ATOMS, _text
from .relational_queries import _SQUARED
from .store_queries import _LATTICE, _POINT, _conorms

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


_GEOMETRY = f"""{_SQUARED}, near AS (SELECT id, sqrt(min(squared)) / {T.DELTA} AS bond FROM sq GROUP BY id),
geo AS (SELECT lat.id, p_partkey % 3 + 1 AS n_atoms, abs(a[1] * b[2] * c[3])::DOUBLE AS volume, bond, p_retailprice AS energy FROM lat JOIN part ON p_partkey = lat.id LEFT JOIN near USING (id)),
lim AS (SELECT n_atoms, min(volume) * 0.8::DOUBLE AS low, max(volume) * 1.2::DOUBLE AS high, min(bond) * 0.75::DOUBLE AS least, (max(energy / n_atoms) + 3) * n_atoms AS ceiling
  FROM geo JOIN supplier ON s_suppkey = id GROUP BY n_atoms)"""


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, shortest bond, energy and number of atoms of every crystal."""
    near = crystal_queries.pair_distances(spark, sf_dir).groupBy("id").agg((F.sqrt(F.min("squared")) / T.DELTA).alias("bond"))
    rows = T.crystals(spark, sf_dir).select("id", F.abs(lattice.determinant(F.col("vectors"))).cast("double").alias("volume"), F.size("labels").alias("n_atoms"))
    return rows.join(near, "id", "left").join(T.nodes(spark, sf_dir), "id")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _geometry(spark, sf_dir).join(T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    return filters.limits_of_ends(ends, "n_atoms")


@query("f8_limits_of_ends", f"WITH {_LATTICE}, {_ATOMS}, {_GEOMETRY} SELECT n_atoms::INT AS n_atoms, round(low, 6) AS low, round(high, 6) AS high, round(least, 6) AS least, round(ceiling, 4) AS ceiling FROM lim")
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds that the crystals of suppliers' numbers imply for those with as many atoms."""
    return _limits(spark, sf_dir).select("n_atoms", *(F.round(c, 6).alias(c) for c in ("low", "high", "least")), F.round("ceiling", 4).alias("ceiling"))


@query("f11_within_limits", f"""WITH {_LATTICE}, {_ATOMS}, {_GEOMETRY} SELECT id FROM geo JOIN lim USING (n_atoms)
WHERE volume > low AND volume < high AND (least IS NULL OR bond IS NULL OR bond > least) AND energy < ceiling""")
def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crystals that pass the bounds of the ends of their number of atoms."""
    rows = _geometry(spark, sf_dir).join(F.broadcast(_limits(spark, sf_dir)), "n_atoms")
    return rows.filter(filters.within_limits(F.col("volume"), F.col("bond"), F.col("energy"))).select("id")


@query("a17_flood_barriers", f"WITH {_POINT} SELECT search, max(energy) AS barrier, count(energy) AS n FROM point WHERE status = 'CLOSED' GROUP BY search")
def flood_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest energy of the points that each search has explored."""
    rows = T.points(spark, sf_dir).filter("status = 'CLOSED'")
    return rows.groupBy("search").agg(F.max("energy").alias("barrier"), F.count("energy").alias("n"))


_REAL = ", ".join(f"v[{k + 1}] * 1.37::DOUBLE + {k} * 0.21::DOUBLE" for k in range(7))


def _real_vonorms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conorms(spark, sf_dir).select("id", F.array(*(F.col("v")[k] * F.lit(1.37) + F.lit(k) * F.lit(0.21) for k in range(7))).alias("x"))


@query("x10_raw_vonorms", f"WITH {_LATTICE}, r AS (SELECT id, [{_REAL}] AS x FROM con) SELECT id, array_to_string(list_transform(x, lambda c: round_even(c / 1.5, 0)::BIGINT), ' ') AS units FROM r")
def raw_vonorms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _real_vonorms(spark, sf_dir).select("id", _text(matrices.discretized(F.col("x"), 1.5)).alias("units"))


def _mended_sql() -> str:
    unit = lambda k: "-sign(gap)" if k < 4 else "sign(gap)"
    cost = "[" + ", ".join(f"round(abs((x[{k + 1}] + {unit(k)}) * 1.5 - w[{k + 1}]) - abs(x[{k + 1}] * 1.5 - w[{k + 1}]), 5)" for k in range(7)) + "]"
    new = "[" + ", ".join(f"(w[{k + 1}] + CASE WHEN place = {k + 1} THEN {unit(k)} ELSE 0 END)::BIGINT" for k in range(7)) + "]"
    gap = "w[1] + w[2] + w[3] + w[4] - w[5] - w[6] - w[7]"
    return f"""WITH RECURSIVE {_LATTICE}, r AS (SELECT id, [{_REAL}] AS x FROM con), f AS (SELECT id, x, list_transform(x, lambda c: round_even(c / 1.5, 0)::BIGINT) AS w FROM r),
m AS (SELECT id, x, w, {gap} AS gap FROM f UNION ALL SELECT id, x, w, {gap} FROM (SELECT id, x, {new} AS w FROM (SELECT id, x, w, gap, list_position({cost}, list_min({cost})) AS place FROM m WHERE gap <> 0)))
SELECT id, array_to_string(w, ' ') AS units FROM m WHERE gap = 0"""


@query("x11_mended_vonorms", _mended_sql())
def mended_vonorms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers near real vonorms whose two sums agree, as vonorms' must."""
    return _real_vonorms(spark, sf_dir).select("id", _text(matrices.mended_vonorms(F.col("x"), 1.5)).alias("units"))


@query("x17_equal_motifs", f"""WITH {_ATOMS}, m AS (SELECT id, string_agg(label || ':' || ((f[1] % {T.DELTA}) + {T.DELTA}) % {T.DELTA} || ',' || ((f[2] % {T.DELTA}) + {T.DELTA}) % {T.DELTA} || ',' || ((f[3] % {T.DELTA}) + {T.DELTA}) % {T.DELTA}, ' '
  ORDER BY label, ((f[1] % {T.DELTA}) + {T.DELTA}) % {T.DELTA}, ((f[2] % {T.DELTA}) + {T.DELTA}) % {T.DELTA}, ((f[3] % {T.DELTA}) + {T.DELTA}) % {T.DELTA}) AS motif FROM atom GROUP BY id)
SELECT id, min(id) OVER (PARTITION BY motif) AS first, (count(*) OVER (PARTITION BY motif))::BIGINT AS n FROM m""")
def equal_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crystal with the first that has the same atoms, whatever their order, and how many have."""
    points = F.transform(matrices.atoms(F.col("coords")), lambda p: matrices.wrapped(p, T.DELTA))
    rows = T.crystals(spark, sf_dir).select("id", matrices.sorted_atoms(F.col("labels"), points).alias("motif"))
    classes = rows.groupBy("motif").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return rows.join(classes, "motif").select("id", "first", "n")


_NEAR = "list_bool_and(list_transform([1, 2, 3], lambda ax: least(({0}[ax] - {1}[ax] + 24) % 12, ({1}[ax] - {0}[ax] + 24) % 12) <= 1))"


@query("x17_matching_motifs", f"""WITH {_ATOMS}, a AS (SELECT id, k, label, list_transform(f, lambda x: (x % {T.DELTA} + {T.DELTA}) % {T.DELTA}) AS f, count(*) OVER (PARTITION BY id, label) AS m FROM atom),
-- one row for each motif and anchor: the other atoms as seen from it
o AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY m, label) AS r FROM a),
seen AS (SELECT o.id, o.k, list_sort(list([a.label, (a.f[1] - o.f[1] + 12) % 12, (a.f[2] - o.f[2] + 12) % 12, (a.f[3] - o.f[3] + 12) % 12]) FILTER (a.k <> o.k)) AS rest,
  list_sort(list(a.label)) AS labels FROM o JOIN a USING (id) WHERE o.r = 1 GROUP BY o.id, o.k),
form AS (SELECT id, labels, min(coalesce(rest, [])) AS form FROM seen GROUP BY id, labels),
head AS (SELECT min(id) AS id FROM form GROUP BY labels, form),
s AS (SELECT id, labels, [x.l for x in rest] AS ls, [x.c for x in rest] AS cs FROM (SELECT id, labels, list_transform(coalesce(rest, []), lambda x: {{'l': x[1], 'c': x[2:4]}}) AS rest FROM seen JOIN head USING (id))),
pair AS (SELECT p.id AS a, q.id AS b, p.ls AS l, q.ls AS m, p.cs AS c, q.cs AS d FROM s p JOIN s q ON p.labels = q.labels AND p.id < q.id)
SELECT DISTINCT a, b FROM pair WHERE CASE len(c) WHEN 0 THEN true WHEN 1 THEN {_NEAR.format('c[1]', 'd[1]')}
  ELSE (l[1] = m[1] AND l[2] = m[2] AND {_NEAR.format('c[1]', 'd[1]')} AND {_NEAR.format('c[2]', 'd[2]')}) OR (l[1] = m[2] AND l[2] = m[1] AND {_NEAR.format('c[1]', 'd[2]')} AND {_NEAR.format('c[2]', 'd[1]')}) END""")
def matching_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of unlike motifs that match, one atom laid on another, within a twelfth of a cell in every coordinate."""
    rows = T.crystals(spark, sf_dir).select("id", "labels", F.transform("coords", lambda x: x / T.DELTA).alias("coords"))
    return motifs.motif_matches(rows, 1.0 / T.DELTA)


_TURNED = "[v[1] * 1.000001, v[2], v[3], v[4], v[5], v[6], v[7] + (id % 2) * 0.001]"


@query("x40_about_equal", f"""WITH {_LATTICE} SELECT id, list_bool_and(list_transform(range(1, 8), lambda k: abs(w[k] - v[k]) <= 1e-8 + 1e-5 * v[k])) AS about, list_sort(v[1:4]) = list_sort([v[4], v[3], v[2], v[1] + id % 2]) AS same
FROM (SELECT id, v, {_TURNED}::DOUBLE[] AS w FROM con)""")
def about_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vonorms against those with a millionth, or with a thousandth more; and their first four in another order."""
    v, odd = F.col("v"), F.col("id") % 2
    w = F.array(v[0] * F.lit(1.000001), *(v[k].cast("double") for k in range(1, 6)), v[6] + odd * F.lit(0.001))
    other = F.array(v[3], v[2], v[1], v[0] + odd)
    return _conorms(spark, sf_dir).select("id", matrices.about_equal(w, v).alias("about"), matrices.same_members(F.slice("v", 1, 4), other).alias("same"))


@query("x4_zero_conorms", f"WITH {_LATTICE} SELECT id, list_sum(list_transform(range(1, 7), lambda k: CASE WHEN abs(d[k]) <= 2 THEN 1 << (k - 1)::INT ELSE 0 END))::INT AS mask FROM con")
def zero_conorms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conorms that count as zero within a tolerance of one."""
    near = F.transform("d", lambda x: F.when(F.abs(x) <= 2, 0).otherwise(x))
    return _conorms(spark, sf_dir).select("id", near.alias("d")).select("id", lattice.zero_mask(F.col("d")).alias("mask"))


@query("o6_sorted_elements", "WITH e AS (SELECT p_partkey AS id, [p_size, p_partkey % 90 + 1, p_size * 2 % 83 + 1]::INT[] AS numbers FROM part) SELECT id, array_to_string(list_sort(numbers, 'DESC'), ' ') AS numbers FROM e")
def sorted_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of three elements put in the order of a key, given back as atomic numbers."""
    size, pk = F.col("p_size").cast("int"), F.col("p_partkey")
    symbols = F.array(*map(F.lit, elements.SYMBOLS))
    numbers = F.array(size, (pk % 90 + 1).cast("int"), (size * 2 % 83 + 1).cast("int"))
    rows = T.read(spark, sf_dir, "part").select(pk.alias("id"), F.transform(numbers, lambda n: F.element_at(symbols, n)).alias("symbols"))
    # the place of a symbol is its number; the order of a key is by falling number
    number = F.transform("symbols", lambda s: F.array_position(symbols, s).cast("int"))
    return rows.select("id", _text(F.sort_array(number, asc=False)).alias("numbers"))


@query("s4_point_json", f"""WITH {_ATOMS}, {_LATTICE} SELECT id, array_to_string(v, ' ') AS lattice, array_to_string(f, ' ') AS first, 1.5::DOUBLE AS xi, {T.DELTA}::INT AS delta, 'Zr O' AS elements
FROM con JOIN atom USING (id) WHERE k = 0""")
def point_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as JSON and read back: lattice, first atom, resolutions and elements."""
    vonorms = store_queries._conorms(spark, sf_dir).select("id", "v")
    rows = T.crystals(spark, sf_dir).join(vonorms, "id").select("id", F.concat("v", F.slice("coords", 1, 3)).alias("key"), F.array(F.lit("Zr"), F.lit("O")).alias("elements"))
    back = structures.from_json(structures.to_json(rows, 1.5, T.DELTA).select("id", "point"))
    return back.select("id", _text(F.slice("key", 1, 7)).alias("lattice"), _text(F.slice("key", 8, 3)).alias("first"), "xi", "delta", F.array_join("elements", " ").alias("elements"))
