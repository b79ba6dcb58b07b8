"""Stores kept in SQLite files, read and taken over into a point store."""

import json
import sqlite3

import pytest

from latticegraph.functions import crystal
from latticegraph.functions.calculators import ConstantCalculator
from latticegraph.sources import sqlite
from latticegraph.sources.points import PointStore

DELTA = 10
START = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 1], DELTA)
NEAR = crystal.neighbours(START, [0, 1], DELTA)


def _file(path, points=(), edges=(), status=(), starts=(), ends=(), mail=(), delta=DELTA, leave_out=None):
    rows = {"point": points, "edge": edges, "metadata": [(delta, 1.5, '["Zr", "O"]')], "search_process": [(1, "first")], "search_start_point": starts, "search_end_point": ends, "search_point_status": status, "incoming_point": mail}
    db = sqlite3.connect(path)
    for name, schema in sqlite.STORE.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        if name != leave_out:
            db.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows[name])
    db.commit()
    db.close()
    return str(path)


def _text(key):
    return json.dumps(list(key))


def test_tables_are_read_in_ranges(spark, tmp_path):
    path = _file(tmp_path / "a b.db", points=[(k, f"[{k}]", None if k % 3 else k / 2, k % 2) for k in range(1, 26)])
    for rows in (1, 7, 1000):
        got = sqlite.read(spark, [path], "point", sqlite.STORE["point"], rows).collect()
        assert {tuple(r)[1:] for r in got} == {(k, f"[{k}]", None if k % 3 else k / 2, k % 2) for k in range(1, 26)} and len(got) == 25
    assert sqlite.read(spark, [path], "edge", sqlite.STORE["edge"]).count() == 0
    with pytest.raises(Exception, match="no such table"):
        sqlite.read(spark, [path], "nothing", "id bigint").collect()


def test_partitions_become_one_store(spark, tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()
    # numbers are those of a file; NEAR[0] stands in both, explored in the second alone
    _file(folder / "0.partition.db", points=[(1, _text(START), -1.0, 1), (2, _text(NEAR[0]), None, 0)], edges=[(1, 2, None), (1, None, _text(NEAR[1])), (1, 2, _text(NEAR[0]))], status=[(1, 1, "closed"), (1, 2, "OPEN")], starts=[(1, 1)], mail=[(1, _text(NEAR[2])), (1, _text(START)), (1, _text(NEAR[2]))])
    _file(folder / "1.partition.db", points=[(1, _text(NEAR[1]), 2.0, 0), (2, _text(NEAR[0]), 3.0, 1)], status=[(1, 1, "OPEN")], ends=[(1, 1)])
    _file(folder / "2.partition.db")
    store = sqlite.load(spark, str(folder), f"file://{tmp_path}/out", rows=1, provider=lambda: ConstantCalculator(7))
    again = PointStore.open(spark, f"file://{tmp_path}/out")
    assert (again.xi, again.delta, again.elements) == (1.5, DELTA, ["Zr", "O"])
    assert {(tuple(r.key), tuple(r.labels), r.energy, r.explored) for r in store.table("point").collect()} == {(START, (0, 1), -1.0, True), (NEAR[0], (0, 1), 3.0, True), (NEAR[1], (0, 1), 2.0, False), (NEAR[2], (0, 1), 7.0, False)}
    edges = [(tuple(r.src), tuple(r.dst)) for r in store.table("edge").collect()]
    assert sorted(edges) == sorted([(START, NEAR[0]), (START, NEAR[1])])
    assert {(r.search, tuple(r.key), r.status) for r in store.table("status").collect()} == {(1, START, "CLOSED"), (1, NEAR[0], "OPEN"), (1, NEAR[1], "OPEN"), (1, NEAR[2], "OPEN")}
    assert {(tuple(r.key), r.kind) for r in store.table("end").collect()} == {(START, "start"), (NEAR[1], "goal")}
    assert [tuple(r) for r in store.table("search").collect()] == [(1, "first", 0.005)]
    assert store.is_complete(1) and store.barrier(1) == -1.0
    plain = sqlite.load(spark, str(folder / "0.partition.db"), f"file://{tmp_path}/plain")
    assert {tuple(r.key): r.energy for r in plain.table("point").collect()} == {START: -1.0, NEAR[0]: None, NEAR[2]: None}


def test_what_is_no_store_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="no store"):
        sqlite.load(spark, str(tmp_path), f"file://{tmp_path}/out")
    lacking = _file(tmp_path / "lacking.db", leave_out="edge")
    with pytest.raises(ValueError, match="edge"):
        sqlite.load(spark, lacking, f"file://{tmp_path}/out")
    _file(tmp_path / "0.partition.db")
    _file(tmp_path / "1.partition.db", delta=20)
    with pytest.raises(ValueError, match="one xi"):
        sqlite.load(spark, str(tmp_path), f"file://{tmp_path}/out")
