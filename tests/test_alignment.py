"""Alignment, wave vectors, variants of goals, the ellipsoid and trajectory files."""

import numpy as np
import pytest

from latticegraph.functions import crystal, geometry, kvectors, pathfinding
from latticegraph.sources import trajectory

DELTA = 8
KEY = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4], [2, 5, 6]], [0, 0, 1], DELTA)
LABELS = [0, 0, 1]


@pytest.mark.parametrize("index", [1, 2, 4, 6])
def test_wave_vectors_and_matrices_go_back_and_forth(index):
    for m in crystal.hermite_matrices(index):
        vectors, order = kvectors.vectors_of(m)
        assert order == index == len(vectors)
        chosen = kvectors.generating_set(vectors, order)
        assert kvectors.group(chosen, order) == vectors
        assert (kvectors.matrix_of(chosen, order) == m).all()


def test_no_generator_is_the_whole_lattice():
    assert (kvectors.matrix_of([], 5) == np.eye(3)).all() and kvectors.generating_set([], 5) == []


def test_alignment_undoes_a_change_of_axes_and_order():
    rng = np.random.default_rng(3)
    cell, at, labels = geometry.cell_from_vonorms([9, 10, 12, 31, 19, 21, 22]), rng.random((3, 3)), [0, 0, 1]
    turn = np.array([[1, 1, 0], [0, 1, 0], [0, -1, 1]])
    other = turn @ cell
    moved = ((at + 0.3) @ np.linalg.inv(turn))[[1, 0, 2]]
    _, back, left = geometry.align(cell, at, other, moved, labels)
    assert left < 1e-9
    assert np.allclose((back - at + 0.5) % 1, 0.5)
    cells, places, gaps = geometry.align_path([cell, other, cell], [at, moved, at], labels)
    assert max(gaps) < 1e-9 and all(np.allclose(c, cells[0]) for c in cells)
    content = trajectory.text(cells, places, ["Zr", "Zr", "O"])
    c, f, e = trajectory.parse(content)
    assert len(c) == 3 and np.allclose(c[0], cells[0], atol=1e-9) and np.allclose(f[1], places[1] % 1, atol=1e-9) and e == ["Zr", "Zr", "O"]
    with pytest.raises(ValueError):
        trajectory.text(cells, places, ["Zr", "O", "Zr"])


def test_cells_of_unlike_size_keep_a_distance():
    cell, at = np.eye(3) * 4, np.array([[0, 0, 0], [0.5, 0.5, 0.5]])
    assert geometry.align(cell, at, cell * 1.1, at, [0, 1])[2] == pytest.approx(0.4 * 3**0.5)


def test_every_variant_of_a_goal_is_the_goal():
    sizes = {}
    for spread in ("light", "partial", "full"):
        rows = pathfinding.goal_variants([KEY], LABELS, DELTA, spread)
        sizes[spread] = {tuple(r) for r in rows.tolist()}
        assert KEY in sizes[spread] or spread != "full"
    assert sizes["light"] <= sizes["partial"] <= sizes["full"]
    for row in sizes["full"]:  # a variant that is a valid lattice in its own right has the key of the goal
        if crystal.is_valid(np.array(row[:7])) and sorted(row[:4]) == sorted(KEY[:4]):
            assert crystal.canonical_key(row[:7], [0, 0, 0, *row[7:]], LABELS, DELTA)[:7] == KEY[:7]


@pytest.mark.parametrize("name", ["manhattan", "weighted", "squared", "unimodular_light", "unimodular_partial", "unimodular_full", "pdd", "pdd_manhattan", "amd"])
def test_estimates_are_zero_at_the_goal_and_searches_arrive(name):
    near = crystal.neighbours(KEY, LABELS, DELTA)[0]
    far = pathfinding.goal_distance(name, [KEY], LABELS, 1.0, DELTA)
    assert far(near) >= 0
    if name not in ("unimodular_light", "unimodular_partial"):
        assert far(KEY) == pytest.approx(0, abs=1e-12)
    found, _, path = pathfinding.a_star([near], [KEY], LABELS, DELTA, heuristic=name, max_iterations=20)
    assert found and path == [near, KEY]
    with pytest.raises(ValueError):
        pathfinding.goal_distance("unknown", [KEY], LABELS, 1.0, DELTA)


def test_ellipsoid_holds_its_ends_and_not_far_points():
    near = crystal.neighbours(KEY, LABELS, DELTA)[0]
    inside = pathfinding.Ellipsoid([near], [KEY], pathfinding.Rows(1.0, DELTA))
    assert inside(near) and inside(KEY)
    assert not inside(crystal.canonical_key([400, 410, 420, 1230, 810, 820, 830], [[0, 0, 0], [3, 1, 4], [2, 5, 6]], LABELS, DELTA))
    accept = pathfinding.Filters(1.0, DELTA, ellipsoid=inside)
    assert accept(KEY)
