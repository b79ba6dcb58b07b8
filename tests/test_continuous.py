"""Forces, relaxation, elastic bands and alignment in continuous space."""

import itertools
import math

import numpy as np
import pytest

from latticegraph.functions import bands, calculators, crystal, forces, geometry
from latticegraph.operators import continuous

CELL = geometry.cell_from_vonorms([9, 10, 12, 31, 19, 21, 22])


def crystals(count, n, seed=0):
    rng = np.random.default_rng(seed)
    return np.array([CELL + 0.2 * rng.normal(size=(3, 3)) for _ in range(count)]), rng.random((count, n, 3)) * 3 - 1


@pytest.mark.parametrize("n", [1, 2, 5])
def test_gradients_are_those_of_the_energy(n):
    cells, fractions = crystals(12, n, n)
    calculator = calculators.PairCalculator()
    energies, by_fraction, by_cell = calculator.gradients(cells, fractions)
    assert np.allclose(energies, calculator.energies(list(zip(cells, fractions))), atol=1e-10)
    _, f, c = forces.numeric_gradients(calculator.energies, cells, fractions)
    scale = 1 + np.abs(by_fraction).max((1, 2))[:, None, None]
    assert (np.abs(f - by_fraction) < 1e-5 * scale).all() and (np.abs(c - by_cell) < 1e-4 * scale).all()
    # shifts of all atoms and turns of the whole change nothing
    assert np.allclose(by_fraction.sum(1), 0, atol=1e-8 * scale.max())
    strain = np.swapaxes(cells, 1, 2) @ by_cell
    assert np.allclose(strain, np.swapaxes(strain, 1, 2), atol=1e-8 * scale.max())


def test_neighbours_of_skewed_cells():
    cells, fractions = crystals(6, 2)
    turn = np.array([[1, 4, 0], [0, 1, 0], [3, -5, 1]])
    a = forces.pair_gradients(cells, fractions)[0]
    b = forces.pair_gradients(turn @ cells, fractions @ np.linalg.inv(turn))[0]
    assert np.allclose(a, b)


def test_near_distances_and_keys_of_many_at_once():
    cells, fractions = crystals(30, 3)
    cells[::3] = np.diag([3.0, 3.0, 4.0])
    fractions[::3] = np.round(fractions[::3] * 8) / 8
    cells[1::4] = np.array([[1, 3, 0], [0, 1, 0], [-2, 0, 1]]) @ cells[1::4]
    each = [geometry.near_distances(c, f, 20) for c, f in zip(cells, fractions)]
    assert np.allclose(forces.near_distances(cells, fractions, 20), each)
    for labels in ([0, 0, 1], [0, 0, 0], [0, 1, 2]):
        want = [crystal.real_key(c, f, labels, 1.5, 12) for c, f in zip(cells, fractions)]
        assert crystal.real_keys(cells, fractions, labels, 1.5, 12).tolist() == list(map(list, want))


def test_energies_never_rise_and_forces_end_small():
    cells, fractions = crystals(20, 3)
    calculator = calculators.PairCalculator()
    before = calculator.gradients(cells, fractions)[0]
    last = before
    for steps in (1, 3, 10, 40):
        _, _, energies, _, done = forces.relax_cells(calculator, cells, fractions, force=1e-3, max_steps=steps)
        assert (energies <= last + 1e-12).all() and done.max() <= steps
        last = energies
    *_, left, done = forces.relax_cells(calculator, cells, fractions, force=0.02, max_steps=2000)
    assert (left <= 0.02).mean() > 0.9
    one, _, energy, _, _ = forces.relax_cells(calculator, np.array([np.eye(3) * 3.4]), np.zeros((1, 1, 3)), force=1e-4, max_steps=3000)
    assert energy[0] <= calculator.energy(np.eye(3) * 3.4, np.zeros((1, 3)))


def test_a_calculator_without_gradients_relaxes_too():
    class Spring(calculators.Calculator):
        def energy(self, cell, fractions):
            return float(((cell - 2 * np.eye(3)) ** 2).sum())

    cells, *_ = forces.relax_cells(Spring(), np.array([np.eye(3) * 3.0]), np.zeros((1, 1, 3)), force=1e-3, max_steps=500)
    assert np.allclose(cells[0] @ cells[0].T, 4 * np.eye(3), atol=1e-2)


def test_saddle_of_two_wells():
    def wells(at):
        x, y = at.T
        bend = y - 0.5 * (1 - x * x)
        return (x * x - 1) ** 2 + 2 * bend**2, np.stack([4 * x * (x * x - 1) + 4 * bend * x, 4 * bend], 1)

    space = bands.FlatSpace(wells)
    chain = bands.resampled(space, [np.array([-1.0, 0]), np.array([1.0, 0])], 8)
    assert np.allclose(bands.lengths(space, chain), 2 / 7)
    band, energies, left, _ = bands.settle(space, chain, force=1e-4, max_steps=5000)
    assert left <= 1e-4 and abs(energies.max() - 1) < 1e-4
    assert np.allclose(band[int(energies.argmax())], [0, 0.5], atol=1e-3)
    _, plain, _, _ = bands.settle(space, chain, climbing=False, force=1e-3, max_steps=5000)
    assert plain.max() <= 1 + 1e-6


def test_bands_of_crystals_do_not_depend_on_axes():
    calculator = calculators.PairCalculator()
    (one, two), places = crystals(2, 2, 3)
    a, b = (one, places[0]), (two, places[0] + 0.05)
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(3, 3)))[0]
    found = []
    for r in (np.eye(3), turn):
        ends = [(c @ r, f) for c, f in (a, b)]
        space = bands.CrystalSpace(calculator, ends)
        found.append(bands.settle(space, bands.resampled(space, ends, 5), force=0.05, max_steps=10)[1])
    assert np.allclose(found[0], found[1], atol=1e-6)


# ---------------------------------------------------------------- alignment


def test_lattice_vectors_are_all_there():
    rng = np.random.default_rng(1)
    box = np.array(list(itertools.product(range(-15, 16), repeat=3)))
    for _ in range(10):
        cell = CELL + 0.5 * rng.normal(size=(3, 3))
        gram = cell @ cell.T
        sizes = np.einsum("ni,ij,nj->n", box, gram, box)
        want = set(map(tuple, box[(sizes <= 36) & box.any(1)].tolist()))
        assert set(map(tuple, geometry.lattice_vectors(gram, 6.0).tolist())) == want
        turn = np.array([[1, 5, 0], [0, 1, 0], [-7, 2, 1]])
        assert len(geometry.lattice_vectors(turn @ gram @ turn.T, 6.0)) == len(want)


def planted_turn(rng):
    while True:
        u = np.eye(3, dtype=int)
        for _ in range(6):
            i, j = rng.choice(3, 2, replace=False)
            u[i] += int(rng.integers(-3, 4)) * u[j]
        if 3 <= np.abs(u).max() <= 10:
            return u


def test_planted_turns_come_back_along_whole_paths():
    rng = np.random.default_rng(5)
    labels = np.array([0, 0, 1, 1])
    for _ in range(10):
        cell, at = CELL * 1.2 + 0.2 * rng.normal(size=(3, 3)), rng.random((4, 3))
        cells, places = [cell], [at]
        for _ in range(4):
            u = planted_turn(rng)
            order = np.concatenate([rng.permutation(2), 2 + rng.permutation(2)])
            cells.append(u @ cell)
            places.append(((at + rng.random(3)) @ np.linalg.inv(u))[order])
        out, back, left = geometry.align_path(cells, places, labels)
        assert max(left) < 1e-8 and all(np.allclose(c, out[0]) for c in out)


def test_alignment_is_the_best_of_all_turns():
    rng = np.random.default_rng(7)
    turns = geometry.unimodular(2)
    for _ in range(6):
        other = CELL + 0.3 * rng.normal(size=(3, 3))
        if np.linalg.det(other) < 0:
            other = -other
        at = rng.random((2, 3))
        moved = at + 0.1 * rng.normal(size=(2, 3))
        first, gram, best = geometry.lower_triangular(CELL), other @ other.T, math.inf
        for turn in turns:
            gap = np.linalg.norm(np.linalg.cholesky(turn @ gram @ turn.T) - first)
            if gap < best:
                to = moved @ np.rint(np.linalg.inv(turn))
                best = min(best, gap + geometry.match_atoms(first, at, (to - to[0] + at[0]) % 1, np.array([0, 1]))[1])
        assert geometry.align(CELL, at, other, moved, [0, 1])[2] == pytest.approx(best, abs=1e-9)


# ---------------------------------------------------------------- operators


def test_relaxed_rows_equal_the_minimiser(spark):
    rows = []
    for n in (1, 2, 3):
        cells, fractions = crystals(5, n, 9)
        rows += [(10 * n + k, c.tolist(), f.ravel().tolist(), list(range(n))) for k, (c, f) in enumerate(zip(cells, fractions))]
    rows += [(99, None, [0.0] * 3, [0]), (98, np.eye(3).tolist(), [], [])]
    df = spark.createDataFrame(rows, "id long, cell array<array<double>>, fractions array<double>, labels array<int>").repartition(3)
    got = {r.id: r for r in continuous.relax_cells(df, force=0.05, max_steps=30).collect()}
    assert set(got) == {r[0] for r in rows[:-2]}
    for i, cell, fractions, labels in rows[:-2]:
        c, f, e, left, steps = forces.relax_cells(calculators.PairCalculator(), np.array([cell]), np.array(fractions).reshape(1, -1, 3), force=0.05, max_steps=30)
        r = got[i]
        assert np.allclose(r.cell, c[0]) and np.allclose(r.fractions, f.ravel()) and r.labels == labels
        assert r.energy == pytest.approx(e[0]) and r.energy <= r.energy_before and r.steps == steps[0]
    assert continuous.relax_cells(df.limit(0)).count() == 0


def test_paths_and_bands_as_rows(spark):
    start = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 1], 8)
    path = [start]
    for _ in range(3):
        path.append(crystal.neighbours(path[-1], [0, 1], 8)[0])
    df = spark.createDataFrame([(1, [list(k) for k in path], [0, 1], 1.0, 8), (2, [list(start)], [0, 1], 1.0, 8)], "path long, keys array<array<bigint>>, labels array<int>, xi double, delta int")
    steps = continuous.aligned_paths(df).orderBy("path", "step").collect()
    assert [(r.path, r.step) for r in steps] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)] and steps[0].left == 0
    band = continuous.elastic_bands(df, images=5, max_steps=20)
    rows = band.orderBy("image").collect()
    assert [r.image for r in rows] == list(range(5)) and {r.path for r in rows} == {1}
    assert rows[0].energy == pytest.approx(geometry.pair_energy(geometry.cell_from_vonorms(start[:7]), crystal.atoms_of(start) / 8))
    (b,) = continuous.barriers(band).collect()
    assert b.barrier == pytest.approx(max(r.energy for r in rows) - rows[0].energy) and b.images == 5
