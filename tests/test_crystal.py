"""Keys, neighbours, geometry, files and searches: published values, brute force and properties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticegraph.functions import crystal, geometry, lattice, pathfinding
from latticegraph.operators import barrier, canonical, sublattice
from latticegraph.sources import cif


def vonorms(cell):
    b = np.vstack([cell, -np.sum(cell, 0)])
    return np.array([*(b**2).sum(1), *(((b[0] + b[j]) ** 2).sum() for j in (1, 2, 3))])


def unimodular(rng):
    m = np.eye(3, dtype=int)
    for _ in range(4):
        i, j = rng.sample(range(3), 2)
        m[i] += rng.choice([-1, 1]) * m[j]
    return m


def test_orientations():
    groups = {0: 1, 1: 2, 2: 3, 3: 4}
    for mask in lattice.possible_masks():
        places, vonorm_places, inverses = crystal.orientations(mask)
        zeros = bin(mask).count("1")
        assert {tuple(p) for p in places.tolist()} == set(lattice.permissible(mask))
        assert len({tuple(sorted(r[:4])) for r in vonorm_places.tolist()}) == groups[zeros]
        assert len({tuple(m) for m in inverses.reshape(-1, 9).tolist()}) == len(inverses)
        if zeros == 3:
            assert len(inverses) == 384


@pytest.mark.parametrize("labels", [[0], [0, 0], [0, 1, 1], [0, 0, 1, 2]])
def test_one_key_for_all_descriptions_and_neighbours_are_mutual(labels):
    rng = random.Random(len(labels))
    for _ in range(3):
        cell = np.diag([rng.choice([3, 4, 5]) for _ in range(3)]) + np.tril(np.array([[rng.choice([-1, 0, 1]) for _ in range(3)] for _ in range(3)]), -1)
        atoms = np.array([[rng.randrange(10) for _ in range(3)] for _ in labels])
        key = crystal.canonical_key(vonorms(cell), atoms, labels, 10)
        assert crystal.canonical_key(key[:7], crystal.atoms_of(key), labels, 10) == key
        for _ in range(4):
            u = unimodular(rng)
            moved = np.rint(atoms @ np.linalg.inv(u)).astype(int) + [rng.randrange(10) for _ in range(3)]
            assert crystal.canonical_key(vonorms(u @ cell), moved, labels, 10) == key
        near = crystal.neighbours(key, labels, 10)
        assert near and len(set(near)) == len(near) and key not in near
        for other in rng.sample(near, min(6, len(near))):
            assert key in crystal.neighbours(other, labels, 10)


@pytest.mark.parametrize("labels", [[0], [0, 0, 1], [0, 1, 1, 1]])
def test_many_keys_at_once_are_those_of_each_alone(labels):
    rng = random.Random(9)
    v, atoms = [], []
    for _ in range(40):
        cell = np.diag([rng.choice([3, 4, 5]) for _ in range(3)]) + np.tril(np.array([[rng.choice([-1, 0, 1]) for _ in range(3)] for _ in range(3)]), -1)
        v.append(vonorms(cell))
        atoms.append([[rng.choice([0, 3, 5]) for _ in range(3)] for _ in labels])
    keys = crystal.canonical_keys(np.array(v), np.array(atoms), np.array(labels), 10)
    assert [tuple(k) for k in keys.tolist()] == [crystal.canonical_key(x, a, labels, 10) for x, a in zip(v, atoms)]
    for kind in ("lattice", "motif", "all"):
        row, near = crystal.neighbour_rows(keys[:12], np.array(labels), 10, kind)
        for k in range(12):
            assert list(map(tuple, near[row == k].tolist())) == crystal.neighbours(keys[k], labels, 10, kind)


def test_lattice_neighbours_are_all_valid_steps_of_all_superbases():
    """One atom: every superbasis of the smallest member of its class, moved, put in form by brute force."""
    for cell in (np.diag([3, 3, 3]), np.diag([3, 4, 5]), np.array([[3, 0, 0], [1, 4, 0], [1, 1, 5]])):
        key = crystal.canonical_key(vonorms(cell), [0, 0, 0], [0], 10)
        classes = {}
        for at in obtuse_superbases(key):
            classes.setdefault(at[0], []).append(at[1])
        moved = {tuple(np.array(min(c)) + s) for c in classes.values() for s in lattice.step_vectors()}
        expected = {crystal.canonical_key(m, [0, 0, 0], [0], 10) for m in moved if crystal.is_valid(np.array(m))} - {key}
        assert set(crystal.neighbours(key, [0], 10, "lattice")) == expected


def obtuse_superbases(key):
    """(primary class, vonorms) of every obtuse superbasis among the short vectors of a lattice, without any catalog."""
    gram = np.array(crystal.doubled_conorms(np.array(key)))
    g = np.zeros((4, 4))
    for k, (i, j) in enumerate(lattice.PAIRS):
        g[i, j] = g[j, i] = gram[k] / 2
    for i in range(4):
        g[i, i] = key[i]
    g = g[:3, :3]
    near = [np.array(x) for x in itertools.product((-2, -1, 0, 1, 2), repeat=3) if any(x)]
    short = {}
    for x in near:
        short.setdefault(tuple(x % 2), []).append(x)
    short = [x for c, xs in short.items() if any(c) for x in xs if x @ g @ x == min(y @ g @ y for y in xs)]
    for a, b, c in itertools.permutations(short, 3):
        if a @ g @ b <= 0 and a @ g @ c <= 0 and b @ g @ c <= 0 and abs(round(np.linalg.det(np.array([a, b, c])))) == 1:
            d = -(a + b + c)
            if all(d @ g @ x <= 0 for x in (a, b, c)):
                vs = [a, b, c, d, a + b, a + c, a + d]
                yield tuple(sorted(tuple(x % 2) for x in vs[:4])), tuple(int(round(x @ g @ x)) for x in vs)


def test_published_lattice_forms():
    a = 4.46
    fcc = np.array([[a / 2, a / 2, 0], [0, a / 2, a / 2], [a / 2, 0, a / 2]])
    forms = {crystal.real_key(m.T @ fcc, [[0, 0, 0]], [0], 1.5, 10) for m in crystal.hermite_matrices(2)}
    assert forms == {(6, 7, 13, 25, 13, 18, 20), (7, 7, 20, 20, 7, 20, 27)}
    bcc = np.array([[-1, 1, 1], [1, -1, 1], [1, 1, -1]]) * 3.52 / 2
    for matrix, members in (([[2, 0, 0], [0, 1, 0], [0, 0, 1]], [6, 8, 17, 23, 6, 23, 25]), ([[2, 1, 0], [0, 1, 1], [0, 0, 1]], [8, 8, 8, 21, 15, 15, 15])):
        key = crystal.real_key(np.array(matrix).T @ bcc, [[0, 0, 0]], [0], 1.5, 10)
        assert sorted(key) == sorted(members) and key <= tuple(members)


def test_real_keys_do_not_depend_on_the_cell():
    rng, gen = random.Random(2), np.random.default_rng(2)
    for _ in range(10):
        cell, at = np.tril(gen.random((3, 3))) * 2 + 3 * np.eye(3), gen.random((3, 3))
        key = crystal.real_key(cell, at, [0, 0, 1], 1.5, 20)
        u = unimodular(rng)
        assert crystal.real_key(u @ cell, at @ np.linalg.inv(u) + gen.random(3), [0, 0, 1], 1.5, 20) == key


def test_assignment_and_distances_of_periodic_sets():
    gen = np.random.default_rng(5)
    for n in (1, 2, 5):
        cost = gen.random((n, n))
        to = geometry.assign(cost)
        assert sorted(to) == list(range(n))
        assert cost[range(n), to].sum() == pytest.approx(min(cost[range(n), list(p)].sum() for p in itertools.permutations(range(n))))
    cell, at = np.tril(gen.random((3, 3))) + 2 * np.eye(3), gen.random((3, 3))
    big, more, _ = crystal.supercell(cell, at, [0, 0, 1], np.array([[2, 1, 0], [0, 1, 0], [0, 0, 2]]))
    x, y = geometry.near_distances(cell, at, 25), geometry.near_distances(big, more, 25)
    assert len(more) == 12 and geometry.pdd_distance(x, y) < 1e-9 and geometry.pdd_distance(x, x + 0.5) == pytest.approx(0.5)
    assert geometry.amd_distance(geometry.amd(cell, at, 25), geometry.amd(big, more, 25)) < 1e-9
    cube = geometry.near_distances(np.eye(3), np.zeros((1, 3)), 18)[0]
    assert cube == pytest.approx([1] * 6 + [2**0.5] * 12)
    assert vonorms(geometry.cell_from_vonorms([4, 9, 16, 29, 13, 20, 25])) == pytest.approx([4, 9, 16, 29, 13, 20, 25])
    order, total = geometry.match_atoms(cell, at, at[[1, 0, 2]], np.array([0, 0, 1]))
    assert order.tolist() == [1, 0, 2] and total == pytest.approx(0)


def test_crystal_files(spark, tmp_path):
    text = """data_x
_cell_length_a 3.2(1)
_cell_length_b 3.2
_cell_length_c 5.1
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 120
_chemical_formula_sum 'Zr1 O1'
loop_
_atom_site_type_symbol
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
Zr4+ Zr0 0.25 0.5 0 1
O2- O1 0.125(3) 0 0.75 0.5
"""
    (tmp_path / "one.cif").write_text(text)
    rows = cif.read(spark, f"file://{tmp_path}/one.cif").collect()
    assert [(r.structure_id, r.a, r.gamma, r.formula) for r in rows] == [("one", 3.2, 120.0, "Zr1 O1")]
    assert [tuple(a) for a in rows[0].atoms] == [("Zr", 0.25, 0.5, 0.0, 1.0), ("O", 0.125, 0.0, 0.75, 0.5)]
    again = cif.parse(cif.text(spark.createDataFrame(rows)).first().text)
    assert again["atoms"] == [tuple(a) for a in rows[0].atoms] and abs(np.linalg.det(cif.cell(again))) == pytest.approx(3.2 * 3.2 * 5.1 * 3**0.5 / 2)
    with pytest.raises(ValueError):
        cif.parse("data_y\n_cell_length_a 1\n")


KEY = crystal.canonical_key([9, 9, 9, 27, 18, 18, 18], [0, 0, 0, 5, 5, 5], [0, 0], 10)


def test_search_finds_shortest_paths_and_filters_hold():
    near = {k: crystal.neighbours(k, [0, 0], 10) for k in [KEY]}
    two = sorted({x for k in near[KEY][:3] for x in crystal.neighbours(k, [0, 0], 10)} - {KEY} - set(near[KEY]))
    found, n, path = pathfinding.a_star([KEY], [two[0]], [0, 0], 10, heuristic="none", max_iterations=2000)
    assert found and len(path) == 3 and n > 0
    assert all(b in crystal.neighbours(a, [0, 0], 10) for a, b in zip(path, path[1:]))
    assert pathfinding.a_star([KEY], [KEY], [0, 0], 10) == (True, 0, [KEY])
    assert not pathfinding.a_star([KEY], [two[0]], [0, 0], 10, accept=lambda k: False)[0]
    assert not pathfinding.a_star([KEY], [two[0]], [0, 0], 10, dropout=1.0)[0]
    with pytest.raises(ValueError):
        pathfinding.a_star([], [KEY], [0, 0], 10)
    energies = pathfinding.Energies(1.0, 10)
    down = [energies(k) for k in pathfinding.descend(KEY, [0, 0], 10, energies, 4)]
    assert down == sorted(down, reverse=True) and len(set(down)) == len(down)
    volume = abs(np.linalg.det(geometry.cell_from_vonorms(KEY[:7])))
    assert not pathfinding.Filters(1.0, 10, volume=(volume, 99))(KEY) and pathfinding.Filters(1.0, 10, volume=(volume - 1, 99))(KEY)


def test_phases(spark):
    energies = pathfinding.Energies(1.0, 10)
    goal = pathfinding.descend(KEY, [0, 0], 10, energies, 2)[-1]
    rows = [(1, [list(KEY)], [list(goal)], [0, 0], 1.0, 10), (2, [], [list(goal)], [0, 0], 1.0, 10)]
    searches = spark.createDataFrame(rows, "search long, starts array<array<bigint>>, goals array<array<bigint>>, labels array<int>, xi double, delta int")
    bounds = {"max_iterations": 40, "beam": 100}
    known = barrier.run(barrier.tasks(searches, **bounds)).cache()
    got = {r.search: r for r in known.collect()}
    assert got[1].found and not got[2].found and got[1].barrier == max(got[1].energies)
    assert [r.search for r in barrier.best_attempts(known).collect()] == [1]
    steps = barrier.path_steps(known).orderBy("step").collect()
    assert [r.kind for r in steps][0] is None and len(steps) == len(got[1].path)
    samples = barrier.sample(searches, 2, **bounds).filter("found").collect()
    assert all(tuple(r.path[0]) == KEY and tuple(r.path[-1]) == goal for r in samples)
    assert all(r.barrier <= got[1].barrier for r in barrier.sweep(searches, known, 2, 1, **bounds).filter("found").collect())
    low = {r.search: r.barrier for r in barrier.ratchet(searches, known, 0.05, rounds=2, failures=1, max_iterations=20).collect()}
    assert set(low) == {1} and low[1] <= got[1].barrier
    least = {r.search: r.distance for r in barrier.parameter_search(searches, high=2.0, tolerance=1.0, **bounds).collect()}
    assert least[2] is None and least[1] >= 0


def test_key_operators(spark):
    v = [int(x) for x in vonorms(np.diag([3, 4, 5]))]
    rows = [(1, v, [0, 1], [0, 0, 0, 5, 5, 5]), (2, v, [0, 1], [5, 5, 5, 0, 0, 0]), (3, None, [0], [0, 0, 0]), (4, v, [], [])]
    crystals = spark.createDataFrame(rows, "id long, v array<bigint>, labels array<int>, coords array<bigint>").withColumn("key", F.lit("clash"))
    keys = canonical.canonical_keys(crystals, 10)
    got = {r.id: r.key for r in keys.collect()}
    assert got[1] == got[2] and got[3] is None and got[4] is None
    pairs = canonical.neighbour_keys(keys, 10).collect()
    assert {tuple(r.neighbour) for r in pairs} == set(crystal.neighbours(tuple(got[1]), [0, 1], 10))
    assert len(pairs) == len({tuple(r.neighbour) for r in pairs})
    assert canonical.geometry_of(keys, 1.0, 10).first().volume == pytest.approx(60)
    atoms = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 5, 5, 5)], "id long, label int, x long, y long, z long")
    cells = sublattice.supercell_atoms(atoms, 3, 10).groupBy(*"abcdef").agg(F.count("*").alias("n"), F.count_distinct("label", "x", "y", "z").alias("m")).collect()
    assert len(cells) == 13 and all(r.n == 6 == r.m for r in cells)


def test_flood_over_computed_neighbours(spark):
    energies = pathfinding.Energies(1.0, 10)
    start = spark.createDataFrame([(list(KEY), [0, 0])], "key array<bigint>, labels array<int>")
    seen, opened = {KEY}, {KEY}
    for _ in range(2):
        low = min(opened, key=lambda k: (energies(k), k))
        fresh = set(crystal.neighbours(low, [0, 0], 10)) - seen
        seen |= fresh
        opened = (opened - {low}) | fresh
    rows = canonical.flood_keys(start, start.select("key").limit(0), 1.0, 10, batch=1, max_steps=2).collect()
    assert {tuple(r.key) for r in rows} == seen and len(rows) == len(seen)
    goal = spark.createDataFrame([(list(crystal.neighbours(KEY, [0, 0], 10)[0]),)], "key array<bigint>")
    assert canonical.flood_keys(start, goal, 1.0, 10, batch=1, max_steps=5).agg(F.max("step")).first()[0] == 1
