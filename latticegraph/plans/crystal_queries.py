"""Queries of the crystal operators, with SQL that finds canonical keys by brute force.

The SQL knows no catalog: it lists the shortest vectors of every class of the reduced lattice, takes all triples that
make an obtuse superbasis and keeps the smallest vonorms and motif.
"""

from __future__ import annotations

import itertools
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crystal, lattice
from ..operators import barrier, bestfirst, canonical, sublattice
from ..sources import cif, cif_source
from ..sources import tables as T
from ..storage import shared_dir
from ..storage import written as _written
from .store_queries import _LATTICE, _MASK, _STEPS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _text(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def _crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.crystals(spark, sf_dir).select("id", lattice.vonorms(lattice.superbasis(F.col("vectors"))).alias("v"), "labels", "coords")


# ---------------------------------------------------------------- SQL by brute force

_ATOMS = f"""atom AS (SELECT p_partkey AS id, k, CASE WHEN k = 0 OR (k = 1 AND p_partkey % 2 = 0) THEN 0 ELSE 1 END AS label,
  [(p_partkey * (k + 1) + k * k * 5) % {T.DELTA}, (p_size * (k + 2) + k) % {T.DELTA}, (p_partkey + p_size * k + k * 3) % {T.DELTA}]::BIGINT[] AS f
  FROM part, range(0, 3) t(k) WHERE k <= p_partkey % 3)"""


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{k}] * {b}[{k}]" for k in (1, 2, 3)) + ")"


def _cross(a: str, b: str) -> str:
    return "[" + ", ".join(f"{a}[{i}] * {b}[{j}] - {a}[{j}] * {b}[{i}]" for i, j in ((2, 3), (3, 1), (1, 2))) + "]"


def _sum(*xs: str) -> str:
    return "[" + ", ".join(" + ".join(f"{x}[{k}]" for x in xs) for k in (1, 2, 3)) + "]"


def _minus(x: str) -> str:
    return "[" + ", ".join(f"-{x}[{k}]" for k in (1, 2, 3)) + "]"


def _turn(pair: int) -> str:
    i, j = lattice.PAIRS[pair]
    row = lambda k: _minus(f"r[{i + 1}]") if k == i else f"r[{j + 1}]" if k == j else _sum(f"r[{k + 1}]", f"r[{i + 1}]")
    return "[" + ", ".join(row(k) for k in range(4)) + "]"


def _superbases_sql():
    """Text of near (shortest vectors of every class) and two (obtuse pairs of them), and what makes conditions and vonorms."""
    gram = lambda x, y: "(" + " + ".join(f"{x}[{i + 1}] * {y}[{j + 1}] * g[{3 * i + j + 1}]" for i in range(3) for j in range(3)) + ")"
    conorms = "[" + ", ".join(gram(f"r[{i + 1}]", f"r[{j + 1}]") for i, j in lattice.PAIRS) + "]"
    turn = "CASE list_position(d, list_max(d)) " + " ".join(f"WHEN {p + 1} THEN {_turn(p)}" for p in range(6)) + " END"
    g = "[" + ", ".join(_dot(x, y) for x, y in itertools.product("abc", repeat=2)) + "]::BIGINT[]"
    mix = "[" + ", ".join(f"x * r[1][{k}] + y * r[2][{k}] + z * r[3][{k}]" for k in (1, 2, 3)) + "]"
    pairs = lambda *names: " AND ".join(gram(x, y) + " <= 0" for x, y in itertools.combinations(names, 2))
    norms = ", ".join(gram(x, x) for x in ("p", "q", "s", "e", _sum("p", "q"), _sum("p", "s"), _sum("p", "e")))
    return f"""gram AS (SELECT id, {g} AS g FROM lat),
turned AS (SELECT id, g, [[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, -1, -1]]::BIGINT[][] AS r FROM gram
  UNION ALL SELECT id, g, {turn} FROM (SELECT id, g, r, {conorms} AS d FROM turned) WHERE list_max(d) > 0),
obtuse AS (SELECT id, g, r FROM (SELECT id, g, r, {conorms} AS d FROM turned) WHERE list_max(d) <= 0),
many AS (SELECT id, g, {mix} AS w, (x & 1) + 2 * (y & 1) + 4 * (z & 1) AS class FROM obtuse, range(-2, 3) a(x), range(-2, 3) b(y), range(-2, 3) c(z)),
near AS (SELECT id, g, w FROM many WHERE class > 0 QUALIFY {gram('w', 'w')} = min({gram('w', 'w')}) OVER (PARTITION BY id, class)),
two AS (SELECT a.id, a.g, a.w AS p, b.w AS q FROM near a JOIN near b ON a.id = b.id AND {gram('a.w', 'b.w').replace('g[', 'a.g[')} <= 0),
""", pairs, norms


def _keys_sql(tail: str) -> str:
    base, pairs, norms = _superbases_sql()
    cross = _cross("p", "q")
    return f"""WITH RECURSIVE {_LATTICE}, {_ATOMS}, {base}
three AS (SELECT id, g, p, q, s, [-(p[1] + q[1] + s[1]), -(p[2] + q[2] + s[2]), -(p[3] + q[3] + s[3])] AS e
  FROM (SELECT two.id, two.g, p, q, near.w AS s, {cross} AS pq FROM two JOIN near USING (id)) WHERE {_dot('pq', 's')} = 1),
w AS (SELECT id, p, q, s, [{norms}]::BIGINT[] AS v FROM three WHERE {pairs('p', 'q', 's', 'e')}),
best AS (SELECT * FROM w QUALIFY v = min(v) OVER (PARTITION BY id)),
{tail}"""


_MOTIF = f"""placed AS (SELECT id, v, p, q, s, k, label, [{', '.join(_dot(_cross(x, y), 'f') for x, y in (('q', 's'), ('s', 'p'), ('p', 'q')))}] AS f FROM best JOIN atom USING (id)),
moved AS (SELECT a.id, a.v, a.p, a.q, a.s, o.k AS o, [a.label, {', '.join(f'((a.f[{k}] - o.f[{k}]) % {T.DELTA} + {T.DELTA}) % {T.DELTA}' for k in (1, 2, 3))}]::BIGINT[] AS x
  FROM placed a JOIN placed o ON a.id = o.id AND a.p = o.p AND a.q = o.q AND a.s = o.s AND o.label = 0),
motif AS (SELECT id, v, list_sort(list(x)) AS m FROM moved GROUP BY id, v, p, q, s, o),
key AS (SELECT id, v, min(m) AS m FROM motif GROUP BY id, v)
SELECT id, array_to_string(v, ' ') AS lnf, coalesce(array_to_string(flatten(list_transform(m[2:], lambda a: a[2:])), ' '), '') AS mnf FROM key"""


@query("k13_canonical_key", _keys_sql(_MOTIF))
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and motif form of every crystal."""
    rows = canonical.canonical_keys(_crystals(spark, sf_dir), T.DELTA)
    return rows.select("id", _text(F.slice("key", 1, 7)).alias("lnf"), _text(F.expr("slice(key, 8, size(key))")).alias("mnf"))


@query("k8_stabilizers", _keys_sql("n AS (SELECT id, count(*) AS n FROM best GROUP BY id) SELECT id, n FROM n"))
def stabilizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of orientations in which a lattice shows its canonical form; each keeps the form from any other."""
    def each(batches):
        for batch in batches:
            row = crystal.lattice_forms(np.array(batch["v"].tolist(), np.int64).reshape(-1, 7))[1]
            yield pd.DataFrame({"id": batch["id"], "n": np.bincount(row, minlength=len(batch))})

    return _crystals(spark, sf_dir).select("id", "v").mapInPandas(each, "id bigint, n bigint")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_keys(_crystals(spark, sf_dir), T.DELTA)


def _neighbour_rows(spark: SparkSession, sf_dir: str, kind) -> DataFrame:
    rows = canonical.neighbour_keys(_keys(spark, sf_dir), T.DELTA, kind)
    return rows.select(_text(F.col("key")).alias("key"), _text(F.col("neighbour")).alias("neighbour"))


# ---------------------------------------------------------------- SQL of neighbours, by brute force over superbases


def _placed(vectors: str) -> str:
    """Coordinates f of an atom in the basis p, q, s of determinant one."""
    return "[" + ", ".join(_dot(_cross(x, y), "f") for x, y in (("q", "s"), ("s", "p"), ("p", "q"))) + "]"


_WRAP = "list_transform({0}, lambda z: (z % " + f"{T.DELTA} + {T.DELTA}) % {T.DELTA})"
_KEY_TEXT = "trim(array_to_string({v}, ' ') || ' ' || coalesce(array_to_string(flatten(list_transform({m}[2:], lambda z: z[2:])), ' '), ''))"
_APART = ", ".join(f"((a.f[{k}] - o.f[{k}]) % {T.DELTA} + {T.DELTA}) % {T.DELTA}" for k in (1, 2, 3))


def _forms(name: str, variants: str, atoms: str, best: str, using: str) -> str:
    """name(key, neighbour): the least motif of every variant over the orientations of its lattice and over origins."""
    return f"""{name}_at AS (SELECT vid, v, p, q, s, k, label, {_placed('')} AS f FROM {variants} JOIN {best} USING ({using}) JOIN {atoms} USING (vid)),
{name}_seen AS (SELECT a.vid, a.v, a.p, a.q, a.s, o.k AS o, list_sort(list([a.label, {_APART}]::BIGINT[])) AS m
  FROM {name}_at a JOIN {name}_at o ON a.vid = o.vid AND a.p = o.p AND a.q = o.q AND a.s = o.s AND o.label = 0 GROUP BY ALL),
{name}_form AS (SELECT vid, v, min(m) AS m FROM {name}_seen GROUP BY vid, v),
{name} AS (SELECT DISTINCT key, {_KEY_TEXT.format(v='f.v', m='f.m')} AS neighbour FROM {name}_form f JOIN {variants} USING (vid) WHERE key.k <> {_KEY_TEXT.format(v='f.v', m='f.m')})"""


def _neighbours_sql(tail: str) -> str:
    """All superbases of a lattice are listed from short vectors, and again those of every moved lattice."""
    base, pairs, norms = _superbases_sql()
    again = re.sub(r"\b(gram|turned|obtuse|many|near|two)\b", r"\1_2", base[base.index("turned AS") :])
    cross, moved = _cross("p", "q"), "[v[5] - v[1] - v[2], v[6] - v[1] - v[3], v[7] - v[1] - v[4], v[7] - v[2] - v[3], v[6] - v[2] - v[4], v[5] - v[3] - v[4]]"
    three = lambda two, near: f"(SELECT id, g, p, q, s, [-(p[1] + q[1] + s[1]), -(p[2] + q[2] + s[2]), -(p[3] + q[3] + s[3])] AS e FROM (SELECT {two}.id, {two}.g, p, q, {near}.w AS s, {cross} AS pq FROM {two} JOIN {near} USING (id)) WHERE {_dot('pq', 's')} = 1)"
    up = lambda x: f"CASE WHEN {x} > {_minus(x)} THEN {x} ELSE {_minus(x)} END"
    keys = _MOTIF[: _MOTIF.rindex("SELECT id")]
    move = " UNION ALL ".join(f"SELECT DISTINCT id, {v} AS w FROM best JOIN rep USING (id)" for x in ("p", "q", "s", _sum("p", "q", "s")) for v in (x, _minus(x)))
    return f"""WITH RECURSIVE {_LATTICE}, {_ATOMS}, {base}
three AS {three('two', 'near')},
w AS (SELECT id, p, q, s, e, [{norms}]::BIGINT[] AS v FROM three WHERE {pairs('p', 'q', 's', 'e')}),
best AS (SELECT id, v, p, q, s FROM w QUALIFY v = min(v) OVER (PARTITION BY id)),
{keys.rstrip()},
rep AS (SELECT min(id) AS id, key FROM (SELECT id, {{'k': {_KEY_TEXT.format(v='v', m='m')}, 'l': l}} AS key FROM key JOIN (SELECT id, list(label ORDER BY k) AS l FROM atom GROUP BY id) USING (id)) GROUP BY key),
-- lattice steps: the least vonorms of every superbasis, all its orientations that show them, and the 42 moves
start AS (SELECT DISTINCT id, key, v FROM (SELECT id, key, min(v) OVER (PARTITION BY id, list_sort([{up('p')}, {up('q')}, {up('s')}, {up('e')}])) AS v FROM w JOIN rep USING (id))),
move_to AS (SELECT DISTINCT id, key, start.v AS v, list_transform(range(1, 8), lambda k: start.v[k] + t.s[k])::BIGINT[] AS to_v FROM start, (SELECT unnest({_STEPS}) AS s) t),
valid AS (SELECT id, key, v, to_v FROM (SELECT id, key, v, to_v, {moved.replace('v[', 'to_v[')} AS d FROM move_to)
  WHERE list_max(d) <= 0 AND to_v[1] + to_v[2] + to_v[3] + to_v[4] = to_v[5] + to_v[6] + to_v[7] AND bit_count({_MASK}) <= 3 AND {_MASK} NOT IN (7, 25, 42, 52)),
gram_2 AS (SELECT to_v AS id, [2 * to_v[1], to_v[5] - to_v[1] - to_v[2], to_v[6] - to_v[1] - to_v[3], to_v[5] - to_v[1] - to_v[2], 2 * to_v[2], to_v[7] - to_v[2] - to_v[3],
  to_v[6] - to_v[1] - to_v[3], to_v[7] - to_v[2] - to_v[3], 2 * to_v[3]]::BIGINT[] AS g FROM (SELECT DISTINCT to_v FROM valid)),
{again}
three_2 AS {three('two_2', 'near_2')},
best_2 AS (SELECT id AS to_v, v, p, q, s FROM (SELECT id, p, q, s, list_transform([{norms}], lambda z: z // 2)::BIGINT[] AS v FROM three_2 WHERE {pairs('p', 'q', 's', 'e')}) QUALIFY v = min(v) OVER (PARTITION BY id)),
shown AS (SELECT w.id, w.v, w.p, w.q, w.s, row_number() OVER (PARTITION BY w.id, w.v ORDER BY w.p, w.q, w.s) AS n FROM w JOIN start ON w.id = start.id AND w.v = start.v),
lattice_variant AS (SELECT [x.id, x.n] || x.to_v || x.v AS vid, key, to_v, id, v0, n FROM (SELECT valid.id, key, to_v, valid.v, valid.v AS v0, n FROM valid JOIN shown ON valid.id = shown.id AND valid.v = shown.v) x),
lattice_atom AS (SELECT vid, k, label, {_WRAP.format(_placed(''))} AS f FROM (SELECT vid, p, q, s, k, label, f FROM lattice_variant l JOIN shown h ON l.id = h.id AND l.v0 = h.v AND l.n = h.n JOIN atom ON atom.id = l.id)),
lattice_use AS (SELECT vid, key, to_v FROM lattice_variant),
{_forms('lattice_near', 'lattice_use', 'lattice_atom', 'best_2', 'to_v')},
-- motif steps: one atom moved along an axis of any orientation that shows the form
axis AS (SELECT DISTINCT id, w FROM ({move})),
motif_use AS (SELECT [axis.id, k] || w AS vid, key, axis.id AS id, k AS k_moved, w FROM axis JOIN rep ON rep.id = axis.id JOIN atom ON atom.id = axis.id WHERE axis.id % 3 > 0),
motif_atom AS (SELECT vid, k, label, list_transform([1, 2, 3], lambda c: f[c] + CASE WHEN k = k_moved THEN w[c] ELSE 0 END) AS f FROM motif_use JOIN atom USING (id)),
motif_pick AS (SELECT vid, key, id FROM motif_use),
{_forms('motif_near', 'motif_pick', 'motif_atom', 'best', 'id')}
{tail}"""


_ALL_NEAR = "(SELECT key, neighbour FROM lattice_near UNION SELECT key, neighbour FROM motif_near)"
_NEAR_SQL = _neighbours_sql(f"SELECT key.k AS key, neighbour FROM {_ALL_NEAR}")
_MEAN_SQL = _neighbours_sql(f"SELECT len(key.l)::INT AS n_atoms, count(*) AS n_points, round(avg(n), 6) AS mean FROM (SELECT key, count(*) AS n FROM {_ALL_NEAR} GROUP BY key) GROUP BY 1")


@query("k17_lattice_neighbours", _neighbours_sql("SELECT key.k AS key, neighbour FROM lattice_near"))
def lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_rows(spark, sf_dir, "lattice")


@query("k18_motif_neighbours", _neighbours_sql("SELECT key.k AS key, neighbour FROM motif_near"))
def motif_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_rows(spark, sf_dir, "motif")


@query("k19_neighbours", _NEAR_SQL)
def all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_rows(spark, sf_dir, "all")


@query("x31_geometry")
def geometry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, shortest bond, pair energy and mean of the average minimum distances of every key."""
    rows = canonical.geometry_of(_keys(spark, sf_dir), 1.0, T.DELTA)
    mean = F.aggregate("amd", F.lit(0.0), lambda s, x: s + x) / F.size("amd")
    return rows.select(_text(F.col("key")).alias("key"), *(F.round(c, 6).alias(c) for c in ("volume", "bond", "energy")), F.round(mean, 6).alias("amd"))


# ---------------------------------------------------------------- supercells, distances, numbers


@query("k23_supercells", f"""WITH {_LATTICE}, {_ATOMS}, m AS (SELECT a AS ga, b AS gb, 2 // (a * b) AS gc, d AS gd, e AS ge, f AS gf FROM range(1, 3) x(a), range(1, 3) y(b), range(0, 2) u(d), range(0, 2) v(e), range(0, 2) w(f)
  WHERE 2 % (a * b) = 0 AND d < a AND e < a AND f < b),
t AS (SELECT *, z1, z2, z3 FROM m, range(0, 2) p(z1), range(0, 2) q(z2), range(0, 2) r(z3) WHERE z1 < ga AND z2 < gb AND z3 < gc),
y AS (SELECT id, ga, gb, gc, gd, ge, gf, label, f[1] + {T.DELTA} * z1 AS y1, f[2] + {T.DELTA} * z2 AS y2, f[3] + {T.DELTA} * z3 AS y3 FROM atom, t)
SELECT id, ga::INT AS a, gb::INT AS b, gc::INT AS c, gd::INT AS d, ge::INT AS e, gf::INT AS f, label,
  (((y1 * gb * gc - gd * gc * y2 + (gd * gf - gb * ge) * y3) % {2 * T.DELTA} + {2 * T.DELTA}) % {2 * T.DELTA})::BIGINT AS x,
  (((ga * gc * y2 - ga * gf * y3) % {2 * T.DELTA} + {2 * T.DELTA}) % {2 * T.DELTA})::BIGINT AS y, ((ga * gb * y3) % {2 * T.DELTA})::BIGINT AS z FROM y""")
def supercells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of all supercells of index two, in units of a half of the old ones."""
    atoms = T.crystals(spark, sf_dir).select("id", F.posexplode("labels").alias("k", "label"), "coords")
    atoms = atoms.select("id", "label", *(F.expr(f"coords[3 * k + {j}]").alias(n) for j, n in enumerate("xyz")))
    return sublattice.supercell_atoms(atoms, 2, T.DELTA)


@query("x21_pair_distances", f"""WITH {_LATTICE}, {_ATOMS}, p AS (SELECT i.id, i.k AS i, j.k AS j, [j.f[1] - i.f[1], j.f[2] - i.f[2], j.f[3] - i.f[3]] AS f FROM atom i JOIN atom j ON i.id = j.id AND i.k < j.k),
n AS (SELECT p.id, i, j, list_transform(range(1, 4), lambda k: (f[1] + {T.DELTA} * x) * a[k] + (f[2] + {T.DELTA} * y) * b[k] + (f[3] + {T.DELTA} * z) * c[k]) AS w
  FROM p JOIN lat USING (id), range(-1, 2) s(x), range(-1, 2) t(y), range(-1, 2) u(z))
SELECT id, i::INT AS i, j::INT AS j, min({_dot('w', 'w')})::BIGINT AS squared FROM n GROUP BY ALL""")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squared distance of every pair of atoms over the 27 cells around, in units of a DELTA-th squared."""
    rows = T.crystals(spark, sf_dir).select("id", "vectors", F.posexplode("labels").alias("i", "label"), "labels", "coords").drop("label")
    rows = rows.select("*", F.explode(F.sequence("i", F.size("labels") - 1)).alias("j")).filter("j > i")
    apart = F.expr("transform(sequence(0, 2), c -> coords[3 * j + c] - coords[3 * i + c])")
    rows = rows.select("id", "i", "j", "vectors", apart.alias("f"))
    images = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=3)))
    at = lambda s: F.array(*(sum((F.col("f")[c] + s[c] * T.DELTA) * F.col("vectors")[c][k] for c in range(3)) for k in range(3)))
    square = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda t, x: t + x * x)
    return rows.select("id", "i", "j", F.array_min(F.transform(images, lambda s: square(at(s)))).alias("squared"))


@query("x24_supercell_indices", """WITH n AS (SELECT s_suppkey AS id, s_nationkey + 1 AS m, s_suppkey % 9 + 1 AS n, s_suppkey % 40 AS least FROM supplier),
l AS (SELECT id, m, n, lcm(m, n) AS l, least FROM n), c AS (SELECT *, CASE WHEN least > l THEN l * CAST(ceil(least / l) AS BIGINT) ELSE l END AS atoms FROM l)
SELECT id, atoms::BIGINT AS atoms, (atoms // m)::BIGINT AS first, (atoms // n)::BIGINT AS second FROM c""")
def supercell_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least common number of atoms of two cells, at least a given one, and the indices that lead there."""
    rows = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1).cast("long").alias("m"), (F.col("s_suppkey") % 9 + 1).alias("n"), (F.col("s_suppkey") % 40).alias("least"))
    return rows.select("id", sublattice.common_atoms("m", "n", "least").alias("atoms"), "m", "n").selectExpr("id", "atoms", "atoms div m as first", "atoms div n as second")


@query("x39_adapted_parameters", """WITH a AS (SELECT o_custkey AS search, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k, max(o_orderkey % 1000) FILTER (o_orderstatus = 'F') AS most, (o_custkey % 10) / 10.0 AS drop FROM orders GROUP BY o_custkey)
SELECT search, round(CASE WHEN 100 * k >= 67 * n THEN drop WHEN 100 * k >= 33 * n THEN greatest(drop - 0.1, 0.05) ELSE greatest(drop * 0.5, 0.05) END::DOUBLE, 6) AS dropout,
  least(CASE WHEN most IS NULL THEN 400 ELSE floor(1.5 * most)::BIGINT END, 1000)::BIGINT AS iterations FROM a""")
def adapted_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropout and iterations for the next batch of attempts, by how many of the last were successful."""
    found, it = F.col("o_orderstatus") == "F", F.col("o_orderkey") % 1000
    rows = T.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("search")).agg(F.count("*").alias("n"), F.count_if(found).alias("k"), F.max(F.when(found, it)).alias("most"))
    drop = (F.col("search") % 10) / 10.0
    dropout = F.when(F.col("k") * 100 >= F.col("n") * 67, drop).when(F.col("k") * 100 >= F.col("n") * 33, F.greatest(drop - 0.1, F.lit(0.05))).otherwise(F.greatest(drop * 0.5, F.lit(0.05)))
    iterations = F.least(F.coalesce(F.floor(F.col("most") * 1.5), F.lit(400)), F.lit(1000))
    return rows.select("search", F.round(dropout, 6).alias("dropout"), iterations.cast("long").alias("iterations"))


@query("w2_cumulative_distance", """WITH s AS (SELECT l_orderkey AS path, l_linenumber AS n, min(l_partkey) AS x, min(l_suppkey) AS y FROM lineitem GROUP BY ALL),
d AS (SELECT *, coalesce(abs(x - lag(x) OVER w) + abs(y - lag(y) OVER w), 0) AS step FROM s WINDOW w AS (PARTITION BY path ORDER BY n))
SELECT path, n, sum(step) OVER (PARTITION BY path ORDER BY n)::BIGINT AS along FROM d""")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y"))
    w = Window.partitionBy("path").orderBy("n")
    step = F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)) + F.abs(F.col("y") - F.lag("y").over(w)), F.lit(0))
    return rows.withColumn("step", step).select("path", "n", F.sum("step").over(w).alias("along"))


@query("w4_subsampled_paths", """WITH s AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS x
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
p AS (SELECT path, n, k, CASE WHEN n <= 3 THEN k ELSE round_even(k * (n - 1) / 2.0, 0)::BIGINT END AS i FROM (SELECT DISTINCT path, n FROM s), range(0, 3) t(k) WHERE k < n)
SELECT path, k::INT AS k, x FROM p JOIN s USING (path, i)""")
def subsampled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three evenly spaced points of every path, ends included; shorter paths whole."""
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", "l_partkey", "l_suppkey").distinct()
    ordered = Window.partitionBy("path").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select("path", F.col("l_partkey").alias("x"), (F.row_number().over(ordered) - 1).alias("i"), F.count("*").over(Window.partitionBy("path")).alias("n"))
    want = F.expr("transform(sequence(0, cast(least(n, 3) as int) - 1), k -> if(n <= 3, k, cast(rint(k * (n - 1) / 2) as int)))")
    return rows.select("path", (F.array_position(want, F.col("i")) - 1).cast("int").alias("k"), "x").filter("k >= 0")


@query("s1_cif_round_trip", f"""WITH {_LATTICE}, {_ATOMS} SELECT p_partkey AS id, (p_partkey % 3 + 1)::INT AS n_atoms, round(abs(a[1] * b[2] * c[3])::DOUBLE, 2) AS volume FROM part JOIN lat ON id = p_partkey""")
def cif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crystals written as text of crystal files and read again: their number of atoms and volume."""
    back = cif.parse_texts(cif.text(_cif_rows(spark, sf_dir)))
    return back.select(F.col("structure_id").cast("long").alias("id"), F.size("atoms").alias("n_atoms"), F.round(_cif_volume(), 2).alias("volume"))


def _cif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crystal in the columns of crystal files."""
    norm = lambda i: F.sqrt(lattice.dot(F.col("vectors")[i], F.col("vectors")[i]))
    angle = lambda i, j: F.degrees(F.acos(lattice.dot(F.col("vectors")[i], F.col("vectors")[j]) / norm(i) / norm(j)))
    atoms = F.expr(f"transform(sequence(0, size(labels) - 1), k -> named_struct('element', if(labels[k] = 0, 'Zr', 'O'), 'x', coords[3 * k] / {T.DELTA}D, 'y', coords[3 * k + 1] / {T.DELTA}D, 'z', coords[3 * k + 2] / {T.DELTA}D, 'occupancy', 1D))")
    return T.crystals(spark, sf_dir).select(F.col("id").cast("string").alias("structure_id"), *(norm(k).alias(n) for k, n in enumerate("abc")), angle(1, 2).alias("alpha"), angle(0, 2).alias("beta"), angle(0, 1).alias("gamma"), F.lit("Zr O").alias("formula"), atoms.alias("atoms"))


def _cif_volume() -> Column:
    cos = {n: F.cos(F.radians(n)) for n in ("alpha", "beta", "gamma")}
    return F.col("a") * F.col("b") * F.col("c") * F.sqrt(1 + cos["alpha"] * cos["beta"] * cos["gamma"] * 2 - sum(x * x for x in cos.values()))


@query("s3_cif_source", ORACLE_SQL["s1_cif_round_trip"] + " WHERE p_partkey::VARCHAR LIKE '1%'")
def cif_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crystals written and read through the format cif; files whose names do not begin with 1 are not opened."""
    cif_source.register(spark)
    folder = f"{shared_dir(spark)}/cif-{uuid.uuid4().hex}"
    _cif_rows(spark, sf_dir).write.format("cif").option("packed", "true").mode("append").save(folder)
    back = spark.read.format("cif").option("names", "1*").load(folder)
    return back.select(F.col("structure_id").cast("long").alias("id"), F.size("atoms").alias("n_atoms"), F.round(_cif_volume(), 2).alias("volume"))


# ---------------------------------------------------------------- searches


@query("g15_relaxed_points")
def relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key, where falling energy leads it within three steps, and the energy there."""
    rows = canonical.relax(_keys(spark, sf_dir), 1.0, T.DELTA, 3)
    return rows.select(_text(F.col("key")).alias("key"), _text(F.element_at("path", -1)).alias("end"), (F.size("path") - 1).alias("steps"), F.round("energy", 6).alias("energy"))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per supplier: from the crystal of its number to where falling energy leads within two steps."""
    owner = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    keys = canonical.canonical_keys(_crystals(spark, sf_dir).join(owner, "id"), T.DELTA)
    keys = _written(keys.select(F.col("id").alias("search"), "key", "labels"), "ends")
    ends = canonical.relax(keys, 1.0, T.DELTA, 2).select("key", "labels", F.element_at("path", -1).alias("end"))
    rows = keys.join(ends, ["key", "labels"]).filter("key <> end")
    return _written(rows.select("search", F.array("key").alias("starts"), F.array("end").alias("goals"), "labels", F.lit(1.0).alias("xi"), F.lit(T.DELTA).alias("delta")), "searches")


_BOUNDS = {"max_iterations": 200, "beam": 1000}  # the operators' defaults


@query("g1_paths")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the path of every search."""
    steps = barrier.path_steps(barrier.run(barrier.tasks(_searches(spark, sf_dir), **_BOUNDS)))
    return steps.select("search", "step", _text(F.col("key")).alias("key"), F.round("energy", 6).alias("energy"), "kind")


@query("g2_large_search")
def large_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the path of every search, found by supersteps over one frontier of all searches instead of inside tasks."""
    searches = _searches(spark, sf_dir)
    alike = _written(bestfirst.members(searches), "members")
    alone = searches.join(alike.filter("search = first").select("search"), "search", "left_semi")  # equal searches go once
    found = bestfirst.best_paths(alone, bestfirst.best_first(alone, heuristic="none", width=10_000))
    return found.withColumnRenamed("search", "first").join(alike, "first").select("search", "step", _text(F.col("key")).alias("key"))


def _summary(rows: DataFrame) -> DataFrame:
    return barrier.summary(rows).select("search", "n", "n_found", F.round("rate", 6).alias("rate"), "most_iterations", F.round("barrier", 6).alias("barrier"))


@query("g18_path_samples")
def path_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(barrier.sample(_searches(spark, sf_dir), 3, **_BOUNDS))


@query("g19_ceiling_sweep")
def ceiling_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts and those under ceilings below their barriers, by resolution: the second pass has a finer one. A path
    that only falls has no room for a ceiling."""
    searches = _searches(spark, sf_dir)
    known = _written(barrier.run(barrier.tasks(searches, **_BOUNDS)), "known")
    every = known.union(barrier.sweep(searches, known, 2, 2, **_BOUNDS))
    rows = every.groupBy("search", "delta").agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), F.round(F.min("barrier"), 6).alias("barrier"))
    return rows.select("search", "delta", "n", "n_found", "barrier")


@query("g20_ratchet")
def ratcheted(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = _searches(spark, sf_dir)
    known = _written(barrier.run(barrier.tasks(searches, **_BOUNDS)), "known")
    rows = barrier.ratchet(searches, known, 0.05, rounds=6, failures=2, **_BOUNDS)
    return rows.select("search", F.round("barrier", 6).alias("barrier"), "rounds", "adaptations")


@query("g17_parameter_search")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest least distance, within 0.75, at which a search still finds its path."""
    return barrier.parameter_search(_searches(spark, sf_dir), low=0.0, high=3.0, tolerance=0.75, **_BOUNDS)


@query("g10_computed_flood")
def computed_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of flooding from all keys, a flood for each list of labels, 100 points a step at most."""
    keys = _keys(spark, sf_dir).filter("key is not null").select("key", "labels").distinct()
    rows = canonical.flood_keys(keys, keys.select("key").limit(0), 1.0, T.DELTA, width=0.5, batch=100, max_steps=3)
    return rows.select(F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"), _text(F.col("key")).alias("key"), _text(F.col("parent")).alias("parent"), F.round("energy", 6).alias("energy"), "step")


@query("w3_resampled_paths", """WITH s AS (SELECT l_orderkey AS path, l_linenumber AS n, min(l_partkey) AS x FROM lineitem GROUP BY ALL),
a AS (SELECT path, n, x, coalesce(sum(abs(x - px)) OVER (PARTITION BY path ORDER BY n), 0)::BIGINT AS along FROM (SELECT *, lag(x) OVER (PARTITION BY path ORDER BY n) AS px FROM s)),
b AS (SELECT *, lead(x) OVER w AS nx, lead(along) OVER w AS nalong, max(along) OVER (PARTITION BY path) AS whole FROM a WINDOW w AS (PARTITION BY path ORDER BY n)),
t AS (SELECT DISTINCT path, k, whole * k AS at4 FROM b, range(0, 5) r(k))
SELECT t.path, k::INT AS k, round(max_by(CASE WHEN nalong IS NULL OR nalong = along THEN x::DOUBLE ELSE x + (nx - x) * (at4 / 4.0 - along) / (nalong - along)::DOUBLE END, n), 6) AS x
FROM t JOIN b ON t.path = b.path AND along * 4 <= at4 GROUP BY ALL""")
def resampled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points of every path, evenly spaced along its length, between the last point passed and the next."""
    # one shuffle and one sort by path, n and x serve all windows; no hash table holds paths
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("x"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("path", "n").orderBy(F.col("x").asc_nulls_last()))).filter("place = 1")
    w = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumn("step", F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)), F.lit(0))).withColumn("along", F.sum("step").over(w))
    rows = rows.select("path", "n", "x", "along", F.lead("x").over(w).alias("nx"), F.lead("along").over(w).alias("nalong"), F.max("along").over(Window.partitionBy("path")).alias("whole"))
    # every place is that of one row: the last that does not lie beyond it
    passed = lambda k: (F.col("along") * 4 <= F.col("whole") * k) & (F.col("nalong").isNull() | (F.col("nalong") * 4 > F.col("whole") * k))
    rows = rows.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), passed))).withColumn("at4", F.col("whole") * F.col("k"))
    flat = F.col("nalong").isNull() | (F.col("nalong") == F.col("along"))
    between = F.col("x") + (F.col("nx") - F.col("x")) * (F.col("at4") / 4 - F.col("along")) / (F.col("nalong") - F.col("along"))
    return rows.select("path", "k", F.round(F.when(flat, F.col("x").cast("double")).otherwise(between), 6).alias("x"))


@query("k24_end_points")
def end_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the supercells of index two of every crystal, at the half of its resolution."""
    rows = T.crystals(spark, sf_dir).select("id", F.transform("vectors", lambda v: v.cast("array<double>")).alias("cell"), F.transform("coords", lambda x: x / T.DELTA).alias("fractions"), "labels", F.lit(2).alias("index"))
    keys = canonical.endpoint_keys(rows, 1.5, T.DELTA)
    return keys.select("id", _text(F.col("key")).alias("key"))
