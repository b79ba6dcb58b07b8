"""Queries of the array functions (permutations, matrices, coordinates, numbers) and of the kernels built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crystal, geometry, kvectors, lattice, matrices, pathfinding
from ..operators import barrier, canonical, continuous, sublattice, tablefunctions
from ..sources import tables as T
from ..storage import written as _written
from .crystal_queries import _ATOMS, _BOUNDS, _MEAN_SQL, _MOTIF, _NEAR_SQL, _keys, _keys_sql, _searches, _text
from .relational_queries import _HERMITE, _PERMS
from .store_queries import _KEYS, _LATTICE, _conorms
from .store_queries import _keys as _vector_keys

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


_MATRIX = "mat AS (SELECT p_partkey AS id, [p_partkey % 3 - 1, p_size % 2, 1] AS a, [1, p_partkey % 2, p_size % 3 - 1] AS b, [p_size % 2, 1, p_partkey % 5 - 2] AS c FROM part)"
_TURN = "[[1, 1, 0], [0, 1, 0], [0, -1, 1]]"  # a change of axes of determinant one
_TURN_ROWS = ((1, 1, 0), (0, 1, 0), (0, -1, 1))


def _matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk, size = F.col("p_partkey"), F.col("p_size").cast("long")
    one = F.lit(1).cast("long")
    m = F.array(F.array(pk % 3 - 1, size % 2, one), F.array(one, pk % 2, size % 3 - 1), F.array(size % 2, one, pk % 5 - 2))
    return T.read(spark, sf_dir, "part").select(pk.alias("id"), m.alias("m"))


def _turn() -> Column:
    return F.array(*(F.array(*(F.lit(x).cast("long") for x in row)) for row in _TURN_ROWS))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.crystals(spark, sf_dir).select("id", "labels", matrices.atoms(F.col("coords")).alias("points"))


def _atom_text(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: F.concat(x["label"].cast("string"), F.lit(":"), F.array_join(F.transform(x["at"], lambda c: c.cast("string")), ","))), " ")


_ATOM_TEXT = "string_agg(label || ':' || f[1] || ',' || f[2] || ',' || f[3], ' ' ORDER BY label, f)"


# ---------------------------------------------------------------- permutations and matrices


@query("x1_superbasis", f"WITH {_LATTICE} SELECT id, array_to_string(e, ' ') AS last FROM basis")
def last_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth vector of the superbasis."""
    return T.lattices(spark, sf_dir).select("id", _text(lattice.superbasis(F.col("vectors"))[3]).alias("last"))


@query("x6_permuted_conorms", f"WITH {_LATTICE}, {_PERMS}, k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS n FROM perm) SELECT id, array_to_string(list_transform(p, lambda x: list_append(d, 0)[x + 1]), ' ') AS moved FROM con JOIN k ON n = id % 168")
def permuted_conorms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven conorms moved by the permutation whose number is the id modulo 168."""
    every = spark.createDataFrame([(k, list(p)) for k, p in enumerate(lattice.automorphisms())], "n int, p array<int>")
    rows = _conorms(spark, sf_dir).withColumn("n", (F.col("id") % 168).cast("int")).join(F.broadcast(every), "n")
    seven = F.concat("d", F.array(F.lit(0).cast("long")))
    return rows.select("id", _text(matrices.permuted(seven, F.col("p"))).alias("moved"))


@query("x7_composed_permutations", f"""WITH {_PERMS}, k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS n FROM perm),
m AS (SELECT p_partkey AS id, list_transform(b.p, lambda x: a.p[x + 1]) AS m FROM part JOIN k a ON a.n = p_partkey % 168 JOIN k b ON b.n = (p_partkey // 168 + p_size * 7) % 168)
SELECT id, array_to_string(m, ' ') AS product, m IN (SELECT p FROM perm) AS inside FROM m""")
def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of two permutations that a part's numbers name, and whether the set holds it."""
    every = spark.createDataFrame([(k, list(p)) for k, p in enumerate(lattice.automorphisms())], "k int, p array<int>")  # 168 rows
    named = lambda k, p: F.broadcast(every.toDF(k, p))
    rows = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 168).cast("int").alias("i"), F.expr("cast((p_partkey div 168 + p_size * 7) % 168 as int)").alias("j"))
    made = rows.join(named("i", "p"), "i").join(named("j", "q"), "j").select("id", matrices.permuted(F.col("p"), F.col("q")).alias("m"))
    return made.join(named("k", "m"), "m", "left").select("id", _text(F.col("m")).alias("product"), F.col("k").isNotNull().alias("inside"))


@query("x9_matrix_algebra", f"""WITH {_MATRIX}, d AS (SELECT *, a[1] * (b[2] * c[3] - b[3] * c[2]) - a[2] * (b[1] * c[3] - b[3] * c[1]) + a[3] * (b[1] * c[2] - b[2] * c[1]) AS det FROM mat)
SELECT id, det::BIGINT AS det, abs(det) = 1 AS unimodular, array_to_string([b[2] * c[3] - b[3] * c[2], a[3] * c[2] - a[2] * c[3], a[2] * b[3] - a[3] * b[2], b[3] * c[1] - b[1] * c[3], a[1] * c[3] - a[3] * c[1], a[3] * b[1] - a[1] * b[3],
  b[1] * c[2] - b[2] * c[1], a[2] * c[1] - a[1] * c[2], a[1] * b[2] - a[2] * b[1]], ' ') AS adjugate, (det * 3)::BIGINT AS trace FROM d""")
def matrix_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinant, adjugate, and the trace of the product of the two."""
    m = F.col("m")
    rows = _matrix_rows(spark, sf_dir).select("id", "m", lattice.determinant(m).alias("det"), matrices.adjugate(m).alias("inverse"))
    p = matrices.product(m, F.col("inverse"))
    return rows.select("id", "det", matrices.is_unimodular(m).alias("unimodular"), _text(F.flatten("inverse")).alias("adjugate"), (p[0][0] + p[1][1] + p[2][2]).alias("trace"))


_X25 = "r AS (SELECT [x, y, z] AS v FROM range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) c(z))"


@query("k25_unimodular", f"""WITH {_X25}, a AS (SELECT p_partkey AS id, [p_partkey % 3 - 1, p_size % 3 - 1, (p_partkey + p_size) % 2] AS v FROM part)
SELECT a.id, count(*) AS n, min(array_to_string(flatten([b.v, c.v]), ' ')) AS first FROM a, r b, r c
WHERE a.v[1] * (b.v[2] * c.v[3] - b.v[3] * c.v[2]) - a.v[2] * (b.v[1] * c.v[3] - b.v[3] * c.v[1]) + a.v[3] * (b.v[1] * c.v[2] - b.v[2] * c.v[1]) = 1 GROUP BY a.id""")
def unimodular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of rows with entries from -1 to 1 complete a part's row to determinant one, and the first of them."""
    every = spark.createDataFrame([(*m[0].tolist(), m[1:].ravel().tolist()) for m in geometry.unimodular(1)], "x bigint, y bigint, z bigint, rest array<bigint>")
    made = every.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.min(_text(F.col("rest"))).alias("first"))  # 26 rows at most
    pk, size = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = T.read(spark, sf_dir, "part").select(pk.alias("id"), (pk % 3 - 1).alias("x"), (size % 3 - 1).alias("y"), ((pk + size) % 2).alias("z"))
    return rows.join(F.broadcast(made), ["x", "y", "z"]).select("id", "n", "first")


@query("k2_reduced_vectors", f"WITH {_LATTICE} SELECT id, abs(a[1] * b[2] * c[3])::BIGINT AS volume, true AS obtuse FROM lat")
def reduced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selling reduction of the vectors themselves keeps the volume and leaves an obtuse superbasis."""
    basis = lattice.selling_reduce_vectors(lattice.superbasis(F.col("vectors")))
    rows = T.lattices(spark, sf_dir).select("id", basis.alias("basis"))
    return rows.select("id", F.abs(lattice.determinant(F.col("basis"))).alias("volume"), lattice.is_obtuse(lattice.doubled_conorms(lattice.vonorms(F.col("basis")))).alias("obtuse"))


# ---------------------------------------------------------------- coordinates and cells


_REAL = "real AS (SELECT p_partkey AS id, [p_retailprice / 997, p_size / 7.0::DOUBLE, -p_retailprice / 613] AS x FROM part)"


def _real(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice") / 997, size / 7.0, -F.col("p_retailprice") / 613).alias("x"))


@query("x12_discretized_coordinates", f"WITH {_REAL} SELECT id, array_to_string(list_transform(x, lambda c: ((round_even(c * {T.DELTA}, 0)::BIGINT % {T.DELTA}) + {T.DELTA}) % {T.DELTA}), ' ') AS at, array_to_string(list_transform(x, lambda c: round_even(c / 0.3, 0)::BIGINT), ' ') AS units FROM real")
def discretized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in delta-ths inside the cell, and numbers in units of 0.3; halves go to even."""
    x = F.col("x")
    return _real(spark, sf_dir).select("id", _text(matrices.discretized_coordinates(x, T.DELTA)).alias("at"), _text(matrices.discretized(x, 0.3)).alias("units"))


_WRAP = f"lambda c: ((c % {T.DELTA}) + {T.DELTA}) % {T.DELTA}"


@query("x14_shifted_motifs", f"WITH {_ATOMS}, s AS (SELECT id, label, list_transform([f[1] + 5, f[2] - 7, f[3] + 11], {_WRAP}) AS f FROM atom) SELECT id, {_ATOM_TEXT} AS atoms FROM s GROUP BY id")
def shifted_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = matrices.shifted(F.col("points"), F.array(*(F.lit(x).cast("long") for x in (5, -7, 11))), T.DELTA)
    return _points(spark, sf_dir).select("id", _atom_text(matrices.sorted_atoms(F.col("labels"), moved)).alias("atoms"))


@query("x15_turned_motifs", f"WITH {_ATOMS}, s AS (SELECT id, label, list_transform([f[1] - f[2], f[2], f[2] + f[3]], {_WRAP}) AS f FROM atom) SELECT id, {_ATOM_TEXT} AS atoms FROM s GROUP BY id")
def turned_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs in the axes of a change of determinant one: coordinates go through its inverse."""
    inverse = matrices.adjugate(_turn())
    return _points(spark, sf_dir).select("id", _atom_text(matrices.sorted_atoms(F.col("labels"), matrices.turned(F.col("points"), inverse, T.DELTA))).alias("atoms"))


@query("x16_inversion_symmetry", f"""WITH {_ATOMS}, o AS (SELECT x.id, x.k, y.k AS o, x.label, list_transform([x.f[1], x.f[2], x.f[3]], {_WRAP}) AS f,
  list_transform([y.f[1] + z.f[1] - x.f[1], y.f[2] + z.f[2] - x.f[2], y.f[3] + z.f[3] - x.f[3]], {_WRAP}) AS g FROM atom x JOIN atom y ON x.id = y.id JOIN atom z ON z.id = x.id AND z.k = 0),
s AS (SELECT id, o, list((label, f) ORDER BY label, f) AS p, list((label, g) ORDER BY label, g) AS q FROM o GROUP BY id, o) SELECT id, bool_or(p = q) AS symmetric FROM s GROUP BY id""")
def inversion_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some point mirrors the motif onto itself; the first atom goes to another of the motif."""
    return _points(spark, sf_dir).select("id", matrices.is_inversion_symmetric(F.col("labels"), F.col("points"), T.DELTA).alias("symmetric"))


@query("x18_cartesian_coordinates", f"WITH {_LATTICE}, {_ATOMS} SELECT atom.id, k::INT AS k, label, (f[1] * a[1] + f[2] * b[1] + f[3] * c[1])::BIGINT AS x, (f[2] * b[2] + f[3] * c[2])::BIGINT AS y, (f[3] * c[3])::BIGINT AS z FROM atom JOIN lat USING (id)")
def cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of atoms, in delta-ths."""
    rows = T.crystals(spark, sf_dir).select("id", "vectors", "labels", F.posexplode(matrices.atoms(F.col("coords"))).alias("k", "f"))
    at = matrices.apply(matrices.transpose(F.col("vectors")), F.col("f"))
    return rows.select("id", "k", F.expr("labels[k]").alias("label"), *(at[j].alias(n) for j, n in enumerate("xyz")))


@query("x19_reconstructed_cells", f"""WITH {_LATTICE}, g AS (SELECT id, v, (v[5] - v[1] - v[2]) / 2 AS ab, (v[6] - v[1] - v[3]) / 2 AS ac, (v[7] - v[1] - v[4]) / 2 AS ad FROM con),
w AS (SELECT id, v, ab, ac, (v[1] + v[2] + v[3] + 2 * ab + 2 * ac) AS rest FROM g), u AS (SELECT *, (v[4] - rest) / 2 AS bc FROM w)
SELECT id, round(sqrt(v[1]), 6) AS a, round(sqrt(v[2]), 6) AS b, round(sqrt(v[3]), 6) AS c, round(sqrt(v[1] * v[2] * v[3] + 2 * ab * ac * bc - v[1] * bc * bc - v[2] * ac * ac - v[3] * ab * ab), 4) AS volume FROM u""")
def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and volume of cells rebuilt from their vonorms alone."""
    rows = _conorms(spark, sf_dir).select("id", matrices.cell_from_vonorms(F.col("v")).alias("cell"))
    cell = F.col("cell")
    return rows.select("id", *(F.round(F.sqrt(lattice.dot(cell[k], cell[k])), 6).alias(n) for k, n in enumerate("abc")), F.round(cell[0][0] * cell[1][1] * cell[2][2], 4).alias("volume"))


@query("x23_resolutions", f"WITH {_LATTICE} SELECT id, ceil(greatest(sqrt(v[1]), sqrt(v[2]), sqrt(v[3])) / 0.35)::BIGINT AS delta FROM con")
def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals at which no step along an edge is longer than 0.35."""
    return T.lattices(spark, sf_dir).select("id", matrices.delta_for(F.col("vectors"), 0.35).alias("delta"))


# ---------------------------------------------------------------- keys and numbers


@query("s5_split_keys", f"WITH {_KEYS} SELECT id, array_to_string(key[1:7], ' ') AS lattice, array_to_string(key[8:], ' ') AS motif, array_to_string(key, ',') || '-Zr O-1.5-{T.DELTA}' AS name FROM k")
def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two parts of a key, and the text that names a point with its elements and resolution."""
    key = F.col("key")
    name = F.concat_ws("-", F.array_join(F.transform(key, lambda x: x.cast("string")), ","), F.lit("Zr O"), F.lit("1.5"), F.lit(str(T.DELTA)))
    return _vector_keys(spark, sf_dir).select("id", _text(F.slice(key, 1, 7)).alias("lattice"), _text(F.slice(key, 8, 1_000_000)).alias("motif"), name.alias("name"))


@query("x26_weighted_distances", f"""WITH {_KEYS}, g AS (SELECT key AS goal FROM k WHERE id = 0)
SELECT id, round(2 * (list_sum(list_transform(range(1, 8), lambda j: abs(key[j] - goal[j]))) + abs(key[8] - goal[8]) * 7.0::DOUBLE), 6) AS apart FROM k, g""")
def weighted_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vector_keys(spark, sf_dir)
    goal = rows.filter("id = 0").select(F.col("key").alias("goal"))
    return rows.crossJoin(F.broadcast(goal)).select("id", F.round(matrices.weighted_manhattan(F.col("key"), F.col("goal")), 6).alias("apart"))


@query("x36_numbers", "SELECT s_suppkey AS id, gcd(s_suppkey, 360)::BIGINT AS gcd, len(list_filter(range(1, 361), lambda d: 360 % d = 0 AND (s_suppkey + 1) % d = 0))::INT AS n_divisors, (360 // gcd(s_suppkey, 360))::BIGINT AS denominator FROM supplier WHERE s_suppkey > 0")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest common divisor with 360, shared divisors of the next number, denominator of the reduced fraction over 360."""
    n = F.col("s_suppkey")
    common = sublattice.greatest_common_divisor(n, F.lit(360).cast("long"))
    divisors = F.size(F.filter(F.sequence(F.lit(1).cast("long"), F.lit(360).cast("long")), lambda d: (F.lit(360) % d == 0) & ((n + 1) % d == 0)))
    rows = T.read(spark, sf_dir, "supplier").filter("s_suppkey > 0")
    return rows.select(n.alias("id"), common.alias("gcd"), divisors.alias("n_divisors"), F.expr("360L").alias("whole")).selectExpr("id", "gcd", "n_divisors", "whole div gcd as denominator")


@query("x37_ordered_triples", "SELECT p_partkey AS id, n, a, b, n // (a * b) AS c FROM (SELECT p_partkey, p_size::BIGINT + p_partkey % 11 AS n FROM part), range(1, 71) x(a), range(1, 71) y(b) WHERE n % (a * b) = 0")
def ordered_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to write a number of each part as a product of three, in order."""
    divisors = lambda n: F.filter(F.sequence(F.lit(1).cast("long"), n), lambda d: n % d == 0)
    rows = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("long") + F.col("p_partkey") % 11).alias("n"))
    rows = rows.filter("n > 0").withColumn("a", F.explode(divisors(F.col("n")))).withColumn("rest", F.expr("n div a"))
    return rows.withColumn("b", F.explode(divisors(F.col("rest")))).selectExpr("id", "n", "a", "b", "rest div b as c")


@query("k22_wave_vectors", """SELECT p_partkey AS id, array_to_string([a, d, e, 0, b, f, 0, 0, n // (a * b)], ' ') AS matrix, true AS back
FROM (SELECT p_partkey, p_size % 4 + 1 AS n FROM part), range(1, 5) x(a), range(1, 5) y(b), range(0, 4) u(d), range(0, 4) v(e), range(0, 4) w(f) WHERE n % (a * b) = 0 AND d < a AND e < a AND f < b""")
def wave_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sublattices of a part's index, each found again from a smallest set of its wave vectors."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for flat in batch["m"]:
                m = np.array(flat).reshape(3, 3)
                vectors, order = kvectors.vectors_of(m)
                out.append(bool((kvectors.matrix_of(kvectors.generating_set(vectors, order), order) == m).all()))
            yield pd.DataFrame({"n": batch["n"], "m": batch["m"], "back": out})

    rows = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).alias("n"))
    # the sublattices of an index are the same for every part, so each is looked at once
    found = sublattice.sublattices(rows.select("n").distinct(), "n").selectExpr("n", "array(a, d, e, 0, b, f, 0, 0, c) as m")
    found = canonical.spread(found, "m").mapInPandas(each, "n int, m array<int>, back boolean")
    return rows.join(found, "n").select("id", _text(F.col("m")).alias("matrix"), "back")


# ---------------------------------------------------------------- kernels


_FAR_TURN = ((1, 3, 0), (2, 7, 0), (9, -4, 1))  # a change of axes of determinant one that no small entries undo


@query("k28_aligned_pairs", _keys_sql(_MOTIF[: _MOTIF.rindex("SELECT id")] + "SELECT DISTINCT trim(array_to_string(v, ' ') || ' ' || coalesce(array_to_string(flatten(list_transform(m[2:], lambda a: a[2:])), ' '), '')) AS key, 0.0::DOUBLE AS left FROM key"))
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance left after every crystal was aligned with itself in axes far from its own, its atoms in reverse order."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = np.array(_FAR_TURN)
        for batch in batches:
            left = []
            for key, labels in zip(batch["key"], batch["labels"]):
                cell, at, labels = geometry.cell_from_vonorms(key[:7]), crystal.atoms_of(key) / T.DELTA, np.array(labels)
                order = np.lexsort((-np.arange(len(labels)), labels))  # reversed inside each label
                left.append(geometry.align(cell, at, turn @ cell, (at @ np.linalg.inv(turn))[order], labels)[2])
            yield pd.DataFrame({"key": batch["key"], "left": left})

    keys = _keys(spark, sf_dir).select("key", "labels").distinct()
    rows = canonical.spread(keys, "key").mapInPandas(each, "key array<bigint>, left double")
    return rows.select(_text(F.col("key")).alias("key"), F.round("left", 6).alias("left"))


@query("k28_aligned_paths")
def aligned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance left between neighbouring crystals of the path of every search, after each was aligned to the one before."""
    rows = continuous.aligned_paths(_paths(spark, sf_dir))
    return rows.select(F.col("path").alias("search"), "step", F.round("left", 6).alias("left"))


@query("v5_relaxed_cells")
def relaxed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crystal with its atoms and cell relaxed by forces: energies before and after, volume, whether forces are small."""
    rows = T.crystals(spark, sf_dir).select("id", F.transform("vectors", lambda v: v.cast("array<double>")).alias("cell"), F.transform("coords", lambda x: x / T.DELTA).alias("fractions"), "labels")
    done = continuous.relax_cells(rows, force=0.05, max_steps=200)
    return done.select("id", F.round("energy_before", 6).alias("energy_before"), F.round("energy", 4).alias("energy"), F.round("volume", 3).alias("volume"), (F.col("energy") <= F.col("energy_before")).alias("lower"), (F.col("force") <= 0.05).alias("settled"))


@query("g25_elastic_bands")
def elastic_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barrier of the elastic band between the ends of every path that a search found."""
    rows = continuous.barriers(continuous.elastic_bands(_paths(spark, sf_dir)))
    return rows.select(F.col("path").alias("search"), F.round("barrier", 4).alias("barrier"), "top", "images", "settled")


@query("x28_variant_distances")
def variant_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of every key to a variant of the smallest key with its labels, for each spread."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("light", "partial", "full")
        for batch in batches:
            far = {}
            for r in batch.itertuples(index=False):
                goal = (tuple(r.goal), tuple(r.labels))
                if goal not in far:
                    far[goal] = [pathfinding.goal_distance(f"unimodular_{n}", [goal[0]], r.labels, 1.0, T.DELTA, 1.0) for n in names]
                yield pd.DataFrame([(r.key, *(f(tuple(r.key)) for f in far[goal]))], columns=["key", *names])

    keys = _keys(spark, sf_dir).select("key", "labels").distinct()
    goals = keys.groupBy("labels").agg(F.min("key").alias("goal"))
    rows = canonical.spread(keys.join(F.broadcast(goals), "labels"), "key").mapInPandas(each, "key array<bigint>, light double, partial double, full double")
    return rows.withColumn("key", _text(F.col("key")))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths found by all searches."""
    searches = _searches(spark, sf_dir)
    found = _written(barrier.run(barrier.tasks(searches, **_BOUNDS)).filter("found"), "found")
    return found.join(searches.select("search", "labels"), "search").select(F.col("search").alias("path"), F.col("path").alias("keys"), "labels", "xi", "delta")


@query("v8_neighbours_in_sql", _NEAR_SQL)
def neighbours_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every key by a table function in SQL."""
    tablefunctions.register(spark)
    keys = _keys(spark, sf_dir).filter("key is not null").select("key", "labels", F.lit(T.DELTA).alias("delta")).distinct()
    rows = spark.sql("SELECT key, neighbour FROM neighbours_of(TABLE({keys}))", keys=canonical.spread(keys, "key"))
    return rows.select(_text(F.col("key")).alias("key"), _text(F.col("neighbour")).alias("neighbour"))


@query("a21_mean_neighbours", _MEAN_SQL)
def mean_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of neighbours by the number of atoms."""
    n = canonical.neighbour_keys(_keys(spark, sf_dir), T.DELTA).groupBy("key", "labels").agg(F.count("*").alias("n"))
    return n.groupBy(F.size("labels").alias("n_atoms")).agg(F.count("*").alias("n_points"), F.round(F.avg("n"), 6).alias("mean"))


@query("g21_parallel_ratchet")
def parallel_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = barrier.parallel_ratchet(_searches(spark, sf_dir), 2, step=0.05, rounds=1, **_BOUNDS)
    return rows.select("search", F.round("barrier", 6).alias("barrier"), "attempts")


@query("g22_iteration_estimate")
def iteration_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barrier.estimate_iterations(_searches(spark, sf_dir), first=4, tries=10)
