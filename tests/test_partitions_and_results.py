"""The partitioned store and flood, refinement of resolutions, retries, and results read back."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from latticegraph.__main__ import main
from latticegraph.functions import crystal, geometry, pathfinding
from latticegraph.operators import barrier, canonical, partitioned
from latticegraph.sources import cif, results, structures

KEY = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 0], 10)


def _owner(text: str, n: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % n


def test_owners_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([(k, "OPEN" if k % 2 else None) for k in range(200)], "id long, status string")
    dealt = rows.withColumn("partition", partitioned.owner(F.col("id"), 7))
    assert all(r.partition == _owner(str(r.id), 7) for r in dealt.collect())
    path = str(tmp_path / "store")
    partitioned.write(dealt, path)
    mine = partitioned.read(spark, path, "id long, status string", 7, [2, 5, 5])
    assert {tuple(r) for r in mine.collect()} == {(k, "OPEN" if k % 2 else None, _owner(str(k), 7)) for k in range(200) if _owner(str(k), 7) in (2, 5)}
    assert partitioned.read(spark, path, "id long, status string", 7).count() == 200
    assert partitioned.read(spark, path, "id long, status string", 7, []).count() == 0
    assert partitioned.guard(mine, [2, 5]).count() == mine.count()
    with pytest.raises(PySparkException):
        partitioned.guard(mine, [2]).collect()
    for bad in ([7], [-1]):
        with pytest.raises(ValueError):
            partitioned.read(spark, path, "id long, status string", 7, bad)
    with pytest.raises(ValueError):
        partitioned.owner(F.col("id"), 0)
    # folders that are not owned are not opened: broken files there do no harm
    for file in (tmp_path / "store").glob("partition=*/*.parquet"):
        if file.parent.name not in ("partition=2", "partition=5"):
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            file.write_bytes(b"broken")
    assert partitioned.read(spark, path, "id long, status string", 7, [2, 5]).count() > 0
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        partitioned.read(spark, path, "id long, status string", 7).agg(F.max("id")).collect()


def test_levels_and_completion(spark):
    points = spark.createDataFrame([(1, 10, 0, "OPEN", 3.0), (1, 11, 0, "OPEN", 2.0), (1, 12, 1, "CLOSED", 1.0), (1, 13, 1, "OPEN", None), (2, 10, 1, None, 5.0)], "search int, id int, partition int, status string, energy double")
    got = {(r.search, r.partition): r.level for r in partitioned.levels(points, 3).collect()}
    assert got == {(1, 0): 2.0} | {k: float("inf") for k in ((1, 1), (1, 2), (2, 0), (2, 1), (2, 2))}
    ends = spark.createDataFrame([(1, 12), (1, 99), (2, 10), (3, 10)], "search int, id int")
    assert {tuple(r) for r in partitioned.completion(points, ends).collect()} == {(1, True), (2, False), (3, False)}
    routed = partitioned.route(spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long"), 50).collect()
    assert {r.dst: r.local for r in routed} == {1: True, 2: _owner("1", 50) == _owner("2", 50)}


def test_flood_over_partitions(spark):
    start = spark.createDataFrame([(list(KEY), [0, 0])], "key array<bigint>, labels array<int>")
    none = start.select("key").limit(0)
    plain = {(tuple(r.key), r.step) for r in canonical.flood_keys(start, none, 1.0, 10, width=0.2, max_steps=2).collect()}
    for n in (1, 5):
        rows = partitioned.flood(start, none, 1.0, 10, n, width=0.2, batch=1000, max_steps=2).collect()
        assert {(tuple(r.key), r.step) for r in rows} == plain and len(rows) == len(plain)
        assert all(r.partition == _owner(" ".join(map(str, r.key)), n) for r in rows)
        home = _owner(" ".join(map(str, KEY)), n)
        assert all(r.from_mail == (r.partition != home) for r in rows if r.step == 1)
    goal = spark.createDataFrame([(list(crystal.neighbours(KEY, [0, 0], 10)[0]),)], "key array<bigint>")
    assert partitioned.flood(start, goal, 1.0, 10, 3, max_steps=5).agg(F.max("step")).first()[0] == 1
    assert partitioned.flood(start.limit(0), none, 1.0, 10, 3).count() == 0


def _searches(spark, level=None):
    energies = pathfinding.Energies(1.0, 10)
    goal = pathfinding.descend(KEY, [0, 0], 10, energies, 2)[-1]
    return spark.createDataFrame([(1, [list(KEY)], [list(goal)], [0, 0], 1.0, 10)], barrier.SEARCH), goal


def test_refined_searches(spark):
    rows, goal = _searches(spark)
    same = barrier.refined(rows.withColumn("level", F.lit(0))).first()
    assert tuple(same.starts[0]) == KEY and (same.xi, same.delta) == (1.0, 10)
    fine = barrier.refined(rows.withColumn("level", F.lit(2)), 0.5, 1.5).first()
    assert (fine.xi, fine.delta) == (0.25, 22)
    cell, at = geometry.cell_from_vonorms(KEY[:7]), crystal.atoms_of(KEY) / 10
    assert tuple(fine.starts[0]) == crystal.real_key(cell, at, [0, 0], 0.25, 22)
    again = geometry.cell_from_vonorms(fine.starts[0][:7], fine.xi)
    assert geometry.shortest_bond(again, crystal.atoms_of(fine.starts[0]) / 22) == pytest.approx(geometry.shortest_bond(cell, at), rel=0.1)


def test_retries_passes_and_adaptations(spark):
    rows, goal = _searches(spark)
    known = barrier.run(barrier.tasks(rows, max_iterations=40)).cache()
    assert known.first().found
    high = known.withColumns({"barrier": F.lit(1e3), "path": F.concat("path", "path")}).cache()
    # no iterations find no path, so every ceiling is tried as often as it may be
    tried = barrier.sweep(rows, high, 2, 2, attempts=3, max_iterations=0).collect()
    assert not any(r.found for r in tried) and sorted(r.attempt for r in tried) == list(range(12))
    assert {(r.attempt >= 6, r.xi, r.delta) for r in tried} == {(False, 1.0, 10), (True, 0.8, 12)}
    energies = pathfinding.Energies(1.0, 10)
    floor = max(energies(KEY), energies(goal))
    assert {round(r.ceiling, 9) for r in tried if r.attempt < 6} == {round(floor + 1e-6, 9), 1e3}
    # under a high ceiling the first try finds the path, and a known barrier at the ends leaves no room
    found = barrier.sweep(rows, high, 1, 1, max_iterations=40).collect()
    assert [(r.attempt, r.found, r.ceiling) for r in found] == [(0, True, 1e3)]
    assert barrier.sweep(rows, high.withColumn("barrier", F.lit(floor)), 3, 1, max_iterations=40).count() == 0
    low = barrier.ratchet(rows, high, 0.05, rounds=20, failures=2, adaptations=1, max_iterations=0).collect()
    assert [tuple(r) for r in low] == [(1, 1e3, 4, 1)]


def test_results_read_back(spark, tmp_path):
    rows, goal = _searches(spark)
    known = barrier.run(barrier.tasks(rows, max_iterations=40)).cache()
    path = str(tmp_path / "results")
    results.write(known, path)
    back = results.read(spark, path)
    assert back.schema == known.schema and back.collect() == known.collect()
    got = results.previous(spark, path).first()
    assert (got.search, got.xi, got.delta) == (1, 1.0, 10) and got.ceiling == pytest.approx(known.first().barrier)
    lines = [{"best_barrier": 2.5, "xi": 1.0}, {"search": 4, "energies": [1.0, 3.0], "xi": 0.5, "delta": 9}, {"search": 4, "barrier": 3.0, "xi": 0.4}, {"search": 5, "found": False}, {"search": 6, "ceiling": 7}]
    (tmp_path / "old.json").write_text("\n".join(map(json.dumps, lines)))
    assert {tuple(r) for r in results.previous(spark, str(tmp_path / "old.json")).collect()} == {(0, 1.0, None, 2.5), (4, 0.4, None, 3.0), (6, None, None, 7.0)}
    (tmp_path / "bad.json").write_text("{no json")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        results.previous(spark, str(tmp_path / "bad.json")).collect()


def test_resolution_rows(spark):
    rows = spark.createDataFrame([(1, np.diag([3.0, 4.0, 5.0]).tolist(), [0.0, 0.0, 0.0, 0.5, 0.5, 0.5], [0, 0])], "id long, cell array<array<double>>, fractions array<double>, labels array<int>")
    grid = rows.crossJoin(spark.createDataFrame([(1.0, 10), (0.01, 1000)], "xi double, delta int"))
    got = {r.xi: r for r in canonical.resolution_rows(grid).collect()}
    key = crystal.real_key([[3, 0, 0], [0, 4, 0], [0, 0, 5]], [[0, 0, 0], [0.5, 0.5, 0.5]], [0, 0], 1.0, 10)
    assert got[1.0].neighbours == len(crystal.neighbours(key, [0, 0], 10)) and got[0.01].pdd < 0.01


def test_phases_from_the_command_line(spark, tmp_path):
    start = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 1], 10)
    end = crystal.neighbours(start, [0, 1], 10)[0]
    rows = spark.createDataFrame([("a", list(start), ["Zr", "O"]), ("b", list(end), ["Zr", "O"])], "structure_id string, key array<bigint>, elements array<string>")
    for r in cif.text(structures.structures_of(rows, 1.5, 10)).collect():
        (tmp_path / f"{r.structure_id}.cif").write_text(r.text)
    ends, base = [str(tmp_path / "a.cif"), str(tmp_path / "b.cif")], ["--xi", "1.5", "--delta", "10"]
    short = ["--iterations", "20", "--attempts", "2", "--rounds", "1"]
    out = str(tmp_path / "sampled.json")
    sampled = [json.loads(x) for x in main([*base, "sample", *ends, *short, "--out", out], spark)]
    top = min(r["barrier"] for r in sampled if r["found"])
    swept = [json.loads(x) for x in main(["sweep", *ends, *short, "--from", out], spark)]
    assert all((r["xi"], r["delta"]) == (1.5, 10) for r in swept) and len(swept) >= len(sampled)
    low = [json.loads(x) for x in main(["ratchet", *ends, *short, "--from", out], spark)]
    assert len(low) == 1 and low[0]["barrier"] <= top and low[0]["adaptations"] == 0
    assert json.loads(main([*base, "find-barrier", *ends, *short], spark)[0])["search"] == 0
    (tmp_path / "empty.json").write_text('{"found": false}\n')
    with pytest.raises(ValueError):
        main(["sweep", *ends, "--from", str(tmp_path / "empty.json")], spark)
