"""The point store in a folder, JSON of points, and the command line."""

import json

import numpy as np
import pytest

from latticegraph.__main__ import main
from latticegraph.functions import crystal, elements, pathfinding
from latticegraph.operators import barrier
from latticegraph.sources import cif, points, structures

DELTA = 6
START = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 1], DELTA)


def keys(spark, *rows, labels=(0, 1)):
    return spark.createDataFrame([(list(k), list(labels)) for k in rows], "key array<bigint>, labels array<int>")


def test_store_floods_like_brute_force(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = points.PointStore.create(spark, path, 1.0, DELTA, ["Zr", "O"])
    far = crystal.canonical_key([400, 410, 420, 1230, 810, 820, 830], [[0, 0, 0], [3, 1, 4]], [0, 1], DELTA)
    number = store.create_search("test", keys(spark, START), keys(spark, far), width=0.0)
    # brute force: the lowest open point is explored
    energies, seen, opened = pathfinding.Energies(1.0, DELTA), {START}, {START}
    closed = []
    for _ in range(2):
        low = min(opened, key=lambda k: (energies(k), k))
        opened.remove(low)
        closed.append(low)
        fresh = set(crystal.neighbours(low, [0, 1], DELTA)) - seen
        seen |= fresh
        opened |= fresh
    assert store.run(number, 2, batch=1) == 2 and not store.is_complete(number)
    again = points.PointStore.open(spark, path)
    rows = {tuple(r.key): r.status for r in again.table("status").collect()}
    assert set(rows) == seen and {k for k, s in rows.items() if s == "CLOSED"} == set(closed)
    assert again.barrier(number) == pytest.approx(max(map(energies, closed)))
    report = {r.kind: r for r in again.check(number).collect()}
    assert report["start"].searched and report["start"].degree > 0 and not report["goal"].reached
    stats = again.status().first()
    assert (stats.n_points, stats.n_open, stats.n_closed) == (len(seen), len(opened), 2)
    # a second search uses the stored edges of explored points, and stops when its goal has a status
    goal = crystal.neighbours(START, [0, 1], DELTA)[0]
    second = again.create_search("short", keys(spark, START), keys(spark, goal))
    n_edges = again.table("edge").count()
    assert again.run(second, 5) == 1 and again.is_complete(second) and again.table("edge").count() == n_edges
    again.set_width(second, 1.0)
    assert again._search(second).width == 1.0


def test_store_refuses_what_it_cannot_hold(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = points.PointStore.create(spark, path, 1.0, DELTA, ["Zr", "O"])
    with pytest.raises(ValueError):
        store.create_search("", keys(spark, START), keys(spark, START).limit(0))
    with pytest.raises(ValueError):
        store.create_search("", keys(spark, START, labels=(0, 0)), keys(spark, START, labels=(0, 0)))
    with pytest.raises(ValueError):
        store.table("nothing")
    with pytest.raises(ValueError):
        store.step(9)
    with pytest.raises(Exception, match="exist"):
        points.PointStore.create(spark, path, 1.0, DELTA, ["Zr", "O"])


def test_points_as_json_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", list(START), ["Zr", "O"]), ("b", [4, 4, 4, 12, 8, 8, 8], ["Li"])], "structure_id string, key array<bigint>, elements array<string>")
    texts = structures.to_json(rows, 1.5, DELTA)
    assert json.loads(texts.filter("structure_id = 'b'").first().point)["mnf"] == {"delta": DELTA, "elements": ["Li"], "coords": []}
    back = {r.structure_id: (tuple(r.key), r.elements, r.xi, r.delta) for r in structures.from_json(texts.select("structure_id", "point")).collect()}
    assert back["a"] == (START, ["Zr", "O"], 1.5, DELTA)
    files = structures.structures_of(rows, 1.5, DELTA)
    again = {r.structure_id: tuple(r.key) for r in structures.keys_of(files, 1.5, DELTA).collect()}
    assert again["b"] == crystal.canonical_key([4, 4, 4, 12, 8, 8, 8], [0, 0, 0], [0], DELTA)
    assert again["a"] == START
    assert elements.heaviest_first(["O", "Zr", "H"]) == ["Zr", "O", "H"] and elements.NUMBER["Og"] == 118


def test_command_line(spark, tmp_path):
    near = crystal.neighbours(START, [0, 1], DELTA)[0]
    rows = spark.createDataFrame([("a", list(START), ["Zr", "O"]), ("b", list(near), ["Zr", "O"])], "structure_id string, key array<bigint>, elements array<string>")
    for r in cif.text(structures.structures_of(rows, 1.5, DELTA)).collect():
        (tmp_path / f"{r.structure_id}.cif").write_text(r.text)
    a, b, base = str(tmp_path / "a.cif"), str(tmp_path / "b.cif"), ["--xi", "1.5", "--delta", str(DELTA)]
    assert json.loads(json.loads(main([*base, "keys", a], spark)[0])["point"])["lnf"]["coords"] == list(START[:7])
    assert len(main([*base, "neighbours", a], spark)) == len(crystal.neighbours(START, [0, 1], DELTA))
    found = json.loads(main([*base, "astar", a, b, "--iterations", "50", "--out", str(tmp_path / "out.json")], spark)[0])
    assert found["found"] and found["path"] == [list(START), list(near)]
    assert json.loads((tmp_path / "out.json").read_text())["found"]
    folder = f"file://{tmp_path}/flood"
    assert json.loads(main([*base, "flood", "setup", folder, a, b], spark)[0]) == {"search": 1}
    assert json.loads(main(["flood", "run", folder, "1", "--steps", "3"], spark)[0])["complete"]
    assert len(main(["flood", "check", folder, "1"], spark)) == 2 and len(main(["flood", "status", folder], spark)) == 1


def test_parallel_ratchet_and_estimates(spark):
    goal = crystal.neighbours(crystal.neighbours(START, [0, 1], DELTA)[0], [0, 1], DELTA)[3]
    rows = spark.createDataFrame([(5, [list(START)], [list(goal)], [0, 1], 1.0, DELTA), (6, [], [list(goal)], [0, 1], 1.0, DELTA)], "search bigint, starts array<array<bigint>>, goals array<array<bigint>>, labels array<int>, xi double, delta int")
    first = {r.search: r.barrier for r in barrier.run(barrier.tasks(rows, max_iterations=40)).collect()}
    got = {r.search: r for r in barrier.parallel_ratchet(rows, 2, step=0.001, rounds=2, max_iterations=40).collect()}
    assert got[5].barrier <= first[5] and got[5].attempts > 1 and got[6].barrier is None and got[6].attempts == 1
    took = {r.search: r for r in barrier.estimate_iterations(rows, first=1, tries=8).collect()}
    assert took[5].iterations >= 2 and took[6].iterations is None and took[6].tries == 8
    low = barrier.relaxed_ends(rows.filter("search = 5")).first()
    energies = pathfinding.Energies(1.0, DELTA)
    assert energies(tuple(low.starts[0])) <= energies(START) and np.isfinite(energies(tuple(low.goals[0])))


def test_metadata_make_a_store_and_come_back(spark, tmp_path):
    from latticegraph.sources import metadata

    goal = crystal.neighbours(START, [0, 1], DELTA)[0]
    text = json.dumps({"description": "two", "xi": 1.0, "delta": DELTA, "atom_list": ["Zr", "O"], "calculator_model": "none", "time_created": "t", "search_processes": [
        {"search_id": 7, "start_cnfs": [list(START)], "end_cnfs": [list(goal)], "time_created": "t"}, {"search_id": 9, "start_cnfs": [list(goal)], "end_cnfs": [list(START), list(goal)], "time_created": "t", "frontier_width": 0.5}]})
    store = metadata.create(spark, f"file://{tmp_path}/store", text)
    assert {r.search: r.width for r in store.table("search").collect()} == {1: metadata.WIDTH, 2: 0.5}
    back = metadata.parse(metadata.of_store(store, "two"))
    assert (back["xi"], back["delta"], back["atom_list"], back["description"]) == (1.0, DELTA, ["Zr", "O"], "two")
    ends = [(p["search_id"], p["start_cnfs"], sorted(p["end_cnfs"])) for p in back["search_processes"]]
    assert ends == [(1, [list(START)], [list(goal)]), (2, [list(goal)], sorted([list(START), list(goal)]))]
    again = metadata.create(spark, f"file://{tmp_path}/again", metadata.of_store(store))
    assert sorted(map(repr, again.table("end").collect())) == sorted(map(repr, store.table("end").collect()))
    for bad in ({"xi": 1.0}, {"xi": 1.0, "delta": 2.5, "atom_list": ["Zr"]}, {"xi": 1.0, "delta": 3, "atom_list": []}):
        with pytest.raises(ValueError):
            metadata.parse(json.dumps(bad))
    with pytest.raises(ValueError):
        metadata.create(spark, f"file://{tmp_path}/odd", text.replace(f'"delta": {DELTA}', '"delta": 2'))


def test_points_of_another_resolution_are_refused(spark, tmp_path):
    from latticegraph.sources import metadata

    store = points.PointStore.create(spark, f"file://{tmp_path}/store", 1.0, DELTA, ["Zr", "O"])
    rows = spark.createDataFrame([(list(START), ["Zr", "O"])], "key array<bigint>, elements array<string>")
    good = structures.to_json(rows, 1.0, DELTA).select("point")
    assert metadata.keys_of_points(store, good).first().key == list(START)
    assert store.create_search("", metadata.keys_of_points(store, good), metadata.keys_of_points(store, good)) == 1
    for odd in (structures.to_json(rows, 1.5, DELTA), structures.to_json(rows, 1.0, DELTA + 1), spark.createDataFrame([("none",)], "point string")):
        with pytest.raises(ValueError):
            metadata.keys_of_points(store, odd.select("point"))
