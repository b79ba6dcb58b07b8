"""Searches called from Python, calculators, derived limits and list comparisons."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticegraph import api
from latticegraph.functions import crystal, filters, geometry, matrices, pathfinding
from latticegraph.functions.calculators import Calculator, ConstantCalculator, PairCalculator
from latticegraph.operators import barrier, canonical

START = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 1], 10)
GOAL = crystal.neighbours(crystal.neighbours(START, [0, 1], 10)[0], [0, 1], 10)[3]


class Tenfold(Calculator):
    def energy(self, cell, fractions):
        return 10 * geometry.pair_energy(cell, fractions)


def test_paths_and_results():
    seen = []
    got = api.pathfind([START], [GOAL], [0, 1], xi=1.0, delta=10, max_iterations=300, on_result=seen.append)
    assert got.found and tuple(got.path[0]) == START and tuple(got.path[-1]) == GOAL and seen == [got]
    assert got.barrier == max(got.energies) and api.PathResult.from_json(got.to_json()) == got
    flat = api.pathfind([START], [GOAL], [0, 1], xi=1.0, delta=10, max_iterations=300, provider=ConstantCalculator)
    assert set(flat.energies) == {0.0}
    assert not api.pathfind([START], [GOAL], [0, 1], xi=1.0, delta=10, max_iterations=5, provider=ConstantCalculator, ceiling=0.0).found
    table = np.array([GOAL])
    own = api.pathfind([START], [GOAL], [0, 1], xi=1.0, delta=10, max_iterations=300, heuristic=lambda key, goals: pathfinding.manhattan(np.array(key), table))
    assert own.path == got.path and api.PathResult(False, 3).barrier is None
    with pytest.raises(ValueError):
        api.pathfind([START], [GOAL], [0, 1], heuristic="unknown")
    cell = np.diag([3.0, 4.0, 5.0])
    assert api.key_of(cell, [[0, 0, 0]], [0], 1.0, 10) == api.key_of(cell[[1, 2, 0]], [[0.5, 0, 0]], [0], 1.0, 10)


def test_calculators_reach_the_operators(spark):
    keys = spark.createDataFrame([(list(START), [0, 1]), (list(GOAL), [0, 1])], "key array<bigint>, labels array<int>")
    plain = {tuple(r.key): r.energy for r in canonical.energies_of(keys, 1.0, 10).collect()}
    tenfold = {tuple(r.key): r.energy for r in canonical.energies_of(keys, 1.0, 10, Tenfold).collect()}
    assert all(tenfold[k] == pytest.approx(10 * plain[k]) for k in plain) and len(plain) == 2
    assert {r.energy for r in canonical.relax(keys, 1.0, 10, 2, lambda: ConstantCalculator(4)).collect()} == {4.0}
    search = spark.createDataFrame([(1, [list(START)], [list(GOAL)], [0, 1], 1.0, 10)], "search long, starts array<array<bigint>>, goals array<array<bigint>>, labels array<int>, xi double, delta int")
    row = barrier.run(barrier.tasks(search), provider=lambda: ConstantCalculator(2)).first()
    assert row.found and set(row.energies) == {2.0}
    assert PairCalculator().identifier == "PairCalculator"


def test_limits_are_exclusive(spark):
    ends = spark.createDataFrame([(1, 10.0, 2.0, -4.0, 2), (1, 20.0, 3.0, -2.0, 2), (2, 5.0, None, 1.0, 1)], "g int, volume double, bond double, energy double, n_atoms int")
    got = {r.g: tuple(r)[1:] for r in filters.limits_of_ends(ends, "g").collect()}
    assert got == {1: (8.0, 24.0, 1.5, 4.0), 2: (4.0, 6.0, None, 4.0)}
    rows = spark.createDataFrame([(1, v, b, e) for v, b, e in ((8.0, 2.0, 0.0), (24.0, 2.0, 0.0), (9.0, 1.5, 0.0), (9.0, 2.0, 4.0), (9.0, 1.6, 3.9), (9.0, None, 3.9))], "g int, volume double, bond double, energy double")
    passed = rows.join(filters.limits_of_ends(ends, "g"), "g").filter(filters.within_limits(F.col("volume"), F.col("bond"), F.col("energy"))).select("bond").collect()
    assert [r.bond for r in passed] == [1.6, None]


def test_lists(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0, 2.00001], [2.0, 1.0], [1.0])], "a array<double>, b array<double>, c array<double>, d array<double>")
    got = row.select(matrices.about_equal(F.col("a"), F.col("b")), matrices.about_equal(F.col("a"), F.col("c")), matrices.about_equal(F.col("a"), F.col("d")), matrices.same_members(F.col("a"), F.col("c"))).first()
    assert tuple(got) == (True, False, False, True)
    rng = np.random.default_rng(2)
    v = [x.tolist() for x in rng.uniform(3, 60, (40, 7))]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, v array<double>")
    for r in df.select("id", matrices.mended_vonorms(F.col("v"), 1.5).alias("w")).collect():
        assert r.w == crystal.discretize_vonorms(np.array(v[r.id]), 1.5).tolist()


def test_matching_minimizes_squares():
    rng = np.random.default_rng(3)
    for _ in range(20):
        cell, a, b = rng.normal(0, 3, (3, 3)), rng.random((5, 3)), rng.random((5, 3))
        labels = np.array([0, 0, 0, 1, 1])
        partner, total = geometry.match_atoms(cell, a, b, labels)
        cost = lambda p: sum(((((b[j] - a[i]) - np.rint(b[j] - a[i])) @ cell) ** 2).sum() for i, j in enumerate(p))  # noqa: B023, E731
        best = min(cost((*p, *q)) for p in itertools.permutations(range(3)) for q in itertools.permutations((3, 4)))
        assert total == pytest.approx(best) and cost(partner) == pytest.approx(best)
