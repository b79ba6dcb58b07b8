"""Lattice algebra: exact counts, invariance under change of basis, and brute force in NumPy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticegraph.functions import crystal, distance, forms, lattice
from latticegraph.operators import sublattice


def test_counts():
    assert len(lattice.automorphisms()) == 168
    assert len(lattice.possible_masks()) == 38
    assert len(lattice.step_vectors()) == 42 == len(set(lattice.step_vectors()))
    sizes = {0: 24, 1: 48, 2: 72, 3: 96}
    assert all(len(lattice.permissible(m)) == sizes[bin(m).count("1")] for m in lattice.possible_masks())


def test_automorphisms_form_a_group():
    group = set(lattice.automorphisms())
    some = random.Random(1).sample(sorted(group), 20)
    assert all(tuple(p[k] for k in q) in group for p, q in itertools.product(some, some))


def random_unimodular(rng):
    m = np.eye(3, dtype=int)
    for _ in range(4):
        i, j = rng.sample(range(3), 2)
        m[i] += rng.choice([-1, 1]) * m[j]
    return m


def test_one_form_for_all_bases_of_a_lattice(spark):
    rng = random.Random(7)
    rows, names = [], []
    cells = [np.diag([4, 4, 4]), np.diag([3, 4, 5]), np.array([[4, 0, 0], [2, 5, 0], [1, 2, 6]]), np.array([[3, 3, 0], [3, 0, 3], [0, 3, 3]]), np.array([[-2, 2, 2], [2, -2, 2], [2, 2, -2]])]
    for k, cell in enumerate(cells):
        for _ in range(12):
            rows.append((len(names), (random_unimodular(rng) @ cell).tolist()))
            names.append(k)
    df = spark.createDataFrame(rows, "id long, vectors array<array<bigint>>")
    got = {r.id: (tuple(r.lnf), r.voronoi) for r in lattice.lattice_forms(df).collect()}
    assert len(got) == len(rows)
    forms = {k: {got[i] for i, n in enumerate(names) if n == k} for k in range(len(cells))}
    assert all(len(f) == 1 for f in forms.values()) and len(set.union(*forms.values())) == len(cells)
    assert next(iter(forms[0]))[1] == 5 and next(iter(forms[4]))[1] == 1


def test_sheared_bases_have_the_form_of_their_lattice(spark):
    rng = random.Random(8)
    cells = [np.eye(3, dtype=int), np.diag([3, 4, 5]), np.array([[4, 0, 0], [2, 5, 0], [1, 2, 6]])]
    rows, names = [], []
    for k, cell in enumerate(cells):
        for s in (0, 20, 21, 200, 1000, 10_000, *(rng.randrange(-10_000, 10_001) for _ in range(8))):
            shear = np.array([[1, 0, 0], [s, 1, 0], [rng.randrange(-50, 51), rng.randrange(-50, 51), 1]])
            rows.append((len(names), (shear @ cell).tolist()))
            names.append(k)
    df = spark.createDataFrame([*rows, (-1, None)], "id long, vectors array<array<bigint>>")
    got = {r.id: r.lnf for r in lattice.lattice_forms(df).collect()}
    assert got.pop(-1) is None
    for (i, basis), k in zip(rows, names):
        b = np.vstack([basis, -np.sum(basis, 0)])
        v = np.array([*(b**2).sum(1), *(((b[0] + b[j]) ** 2).sum() for j in (1, 2, 3))])
        assert got[i] == got[names.index(k)] == crystal.lattice_form(v)[0].tolist()
    turned = df.filter("id >= 0").select("id", lattice.selling_reduce_vectors(lattice.superbasis(F.col("vectors"))).alias("r")).collect()
    for r in turned:
        b = np.array(r.r)
        assert (b.sum(0) == 0).all() and all(b[i] @ b[j] <= 0 for i, j in lattice.PAIRS)
        assert abs(round(np.linalg.det(b[:3]))) == round(np.linalg.det(cells[names[r.id]]))


def test_conorms_of_no_lattice_raise():
    with pytest.raises(ValueError):
        forms.selling(np.array([[5, 0, 0, 0, 0, 0]]))


def test_vonorms_match_numpy(spark):
    rng = np.random.default_rng(3)
    cells = rng.integers(-6, 7, (40, 3, 3))
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(cells)], "id long, vectors array<array<bigint>>")
    v = lattice.vonorms(lattice.superbasis(F.col("vectors")))
    got = {r.id: r for r in df.select("id", v.alias("v"), lattice.doubled_conorms(v).alias("d"), lattice.determinant(F.col("vectors")).alias("det"), lattice.is_superbasis(v).alias("ok")).collect()}
    for k, c in enumerate(cells):
        b = np.vstack([c, -c.sum(0)])
        assert got[k].v == [*(b**2).sum(1), *(((b[0] + b[j]) ** 2).sum() for j in (1, 2, 3))]
        assert got[k].d == [2 * b[i] @ b[j] for i, j in lattice.PAIRS] and got[k].ok
        assert got[k].det == round(np.linalg.det(c))


@pytest.mark.parametrize(("index", "count"), [(1, 1), (2, 7), (3, 13), (4, 35)])
def test_sublattices(spark, index, count):
    rows = sublattice.hermite_matrices(spark, index).collect()
    assert len(set(rows)) == len(rows) == count and all(r.a * r.b * r.c == index for r in rows)


def test_distances(spark):
    row = spark.createDataFrame([([1, 2, 3], [4, 0, 3], [[4, 0, 3], [1, 2, 4]])], "a array<bigint>, b array<bigint>, g array<array<bigint>>")
    got = row.select(distance.manhattan(F.col("a"), F.col("b")), distance.squared_euclidean(F.col("a"), F.col("b")), distance.nearest_goal(F.col("a"), F.col("g")), distance.parse_key(distance.key_text(F.col("a")))).first()
    assert tuple(got) == (10, 13, 2, [1, 2, 3])
