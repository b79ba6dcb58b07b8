"""Lattice algebra as column expressions: superbases, vonorms, doubled conorms, Selling reduction, canonical form.

Integers are exact. Conorms are stored doubled, so a zero test never meets a fraction.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import forms
from .forms import CHARACTERS, CLASSES, PAIRS, SUPPORT, automorphisms, permissible, possible_masks, selling_step_places  # noqa: F401


def superbasis(vectors: Column) -> Column:
    """The three vectors and minus their sum."""
    total = F.array(*(-(vectors[0][k] + vectors[1][k] + vectors[2][k]) for k in range(3)))
    return F.array(vectors[0], vectors[1], vectors[2], total)


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def vonorms(basis: Column) -> Column:
    """The seven squared lengths of a superbasis."""
    plus = lambda i, j: F.array(*(basis[i][k] + basis[j][k] for k in range(3)))
    vs = [basis[i] for i in range(4)] + [plus(0, j) for j in (1, 2, 3)]
    return F.array(*(dot(v, v) for v in vs))


def doubled_conorms(v: Column) -> Column:
    """Twice the dot products of the six pairs, from the vonorms."""
    return F.array(v[4] - v[0] - v[1], v[5] - v[0] - v[2], v[6] - v[0] - v[3], v[6] - v[1] - v[2], v[5] - v[1] - v[3], v[4] - v[2] - v[3])


def basis_conorms(basis: Column) -> Column:
    """Twice the dot products of the six pairs, from a superbasis."""
    return F.array(*(dot(basis[i], basis[j]) * 2 for i, j in PAIRS))


def is_superbasis(v: Column) -> Column:
    return v[0] + v[1] + v[2] + v[3] == v[4] + v[5] + v[6]


def is_obtuse(d: Column) -> Column:
    return F.array_max(d) <= 0


def zero_mask(d: Column) -> Column:
    """Bit k is set if conorm k is zero."""
    return sum((F.when(d[k] == 0, 1 << k).otherwise(0) for k in range(1, 6)), F.when(d[0] == 0, 1).otherwise(0))


def voronoi_class(mask: Column) -> Column:
    """1 to 5 by the number of zero conorms, and for two by whether their pairs share a vector."""
    table = []
    for m in range(64):
        zeros = [PAIRS[k] for k in range(6) if m >> k & 1]
        shared = len(zeros) == 2 and bool({*zeros[0]} & {*zeros[1]})
        table.append({0: 1, 1: 2, 2: 4 if shared else 3, 3: 5}.get(len(zeros)))
    return F.element_at(F.array(*map(F.lit, table)), mask + 1)  # the mask is named once, so plans that inline it stay small


def _whole_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of a column have width whole numbers and no null, and those lists."""
    lists = column.to_numpy(zero_copy_only=False)
    ok = np.array([x is not None and len(x) == width for x in lists], bool)
    rows = np.array([x for x, good in zip(lists, ok) if good], float if column.flatten().null_count else np.int64).reshape(-1, width)
    if rows.dtype != np.int64:
        finite = np.isfinite(rows).all(1)
        ok[np.flatnonzero(ok)[~finite]] = False
        rows = rows[finite].astype(np.int64)
    return ok, rows


def _lists(ok: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A column of the rows at the places that are ok, null elsewhere."""
    offsets = np.concatenate([[0], np.cumsum(np.where(ok, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), pa.int64()), mask=pa.array(~ok))


@lru_cache(1)
def _selling_udf():
    def reduce(d: pa.Array) -> pa.Array:
        ok, rows = _whole_rows(d, 6)
        return _lists(ok, forms.selling(rows)[0])

    return F.arrow_udf(reduce, ArrayType(LongType()))


def selling_reduce(d: Column) -> Column:
    """Doubled conorms of an obtuse superbasis: the largest conorm is removed until none is positive.

    Loops of unknown length are beyond expressions, so whole Arrow batches are reduced at once; obtuse rows pass.
    Null where a conorm is; numbers that are the conorms of no lattice raise.
    """
    return _selling_udf()(d)


@lru_cache(1)
def _form_udf():
    def canonical(d: pa.Array) -> pa.Array:
        ok, rows = _whole_rows(d, 6)
        return _lists(ok, forms.canonical_vonorms(rows))

    return F.arrow_udf(canonical, ArrayType(LongType()))


def canonical_vonorms(d: Column) -> Column:
    """The lexicographically smallest vonorms of an obtuse superbasis over the permissible permutations."""
    return _form_udf()(d)


def catalog(spark: SparkSession) -> DataFrame:
    """mask, voronoi class and permissible permutations of every possible zero set: a table of fixed size."""
    rows = [(mask, [list(p) for p in permissible(mask)]) for mask in possible_masks()]
    df = spark.createDataFrame(rows, "mask int, perms array<array<int>>")
    return df.select("mask", voronoi_class(F.col("mask")).alias("voronoi"), "perms")


def lattice_forms(lattices: DataFrame) -> DataFrame:
    """id, lnf (array of seven) and voronoi of lattices (id, vectors), whatever basis they are given in."""
    staged = lattices.select("id", superbasis(F.col("vectors")).alias("b"))
    staged = staged.select("id", basis_conorms(F.col("b")).alias("d"))
    staged = staged.select("id", selling_reduce(F.col("d")).alias("d"))
    staged = staged.select("id", zero_mask(F.col("d")).alias("mask"), canonical_vonorms(F.col("d")).alias("lnf"))
    return staged.select("id", "lnf", voronoi_class(F.col("mask")).alias("voronoi"))


def step_vectors() -> list[tuple[int, ...]]:
    """The 42 moves of a vonorm list: two entries change by one and the two sums stay equal."""
    out = set()
    for i, j in itertools.combinations(range(7), 2):
        opposite = (i < 4) == (j < 4)
        for a in (1, -1):
            v = [0] * 7
            v[i], v[j] = a, -a if opposite else a
            out.add(tuple(v))
    return sorted(out)


def determinant(m: Column) -> Column:
    x = lambda i, j: m[i][j]
    return x(0, 0) * (x(1, 1) * x(2, 2) - x(1, 2) * x(2, 1)) - x(0, 1) * (x(1, 0) * x(2, 2) - x(1, 2) * x(2, 0)) + x(0, 2) * (x(1, 0) * x(2, 1) - x(1, 1) * x(2, 0))


@lru_cache(1)
def _vectors_udf():
    def reduce(flat: pa.Array) -> pa.Array:
        ok, rows = _whole_rows(flat, 12)
        basis = rows.reshape(-1, 4, 3)
        products = np.stack([2 * (basis[:, i] * basis[:, j]).sum(1) for i, j in PAIRS], 1).reshape(-1, 6)
        return _lists(ok, forms.selling(products, basis)[1].reshape(-1, 12))

    return F.arrow_udf(reduce, ArrayType(LongType()))


def selling_reduce_vectors(basis: Column) -> Column:
    """Four vectors of an obtuse superbasis of the same lattice: the pair of largest product is turned until none is positive."""
    flat = _vectors_udf()(F.flatten(basis))
    return F.when(flat.isNotNull(), F.array(*(F.slice(flat, 3 * k + 1, 3) for k in range(4))))
