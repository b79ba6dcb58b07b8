"""Distributed best-first search, chains of parents, progress that outlives a driver, and listeners."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from latticegraph.functions import crystal, pathfinding
from latticegraph.operators import bestfirst, canonical, search, supersteps

DELTA = 8
LABELS = [0, 1]
KEY = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], LABELS, DELTA)
SEARCH = "search bigint, starts array<array<bigint>>, goals array<array<bigint>>, labels array<int>, xi double, delta int"


def walk(seed, steps):
    rng, key = random.Random(seed), KEY
    for _ in range(steps):
        key = rng.choice(crystal.neighbours(key, LABELS, DELTA))
    return key


@pytest.fixture(scope="module")
def searches(spark):
    rows = [(k, [list(KEY)], [list(walk(k + 3, 3)), list(walk(k + 50, 3))], LABELS, 1.0, DELTA) for k in range(2)]
    rows.append((9, [list(KEY)], [list(KEY)], LABELS, 1.0, DELTA))
    return spark.createDataFrame(rows, SEARCH)


def shortest(row):
    """Length of a shortest path, level by level."""
    level, seen, goals = {tuple(row.starts[0])}, set(), set(map(tuple, row.goals))
    for k in range(10):
        if level & goals:
            return k
        seen |= level
        level = {n for key in level for n in crystal.neighbours(key, LABELS, DELTA)} - seen
    return None


@pytest.mark.parametrize(("heuristic", "weight", "width"), [("none", 1.0, 1), ("manhattan", 1e-3, 200)])
def test_paths_are_shortest(searches, heuristic, weight, width):
    reached = bestfirst.best_first(searches, heuristic=heuristic, weight=weight, width=width)
    ways = {}
    for r in bestfirst.best_paths(searches, reached).orderBy("search", "step").collect():
        ways.setdefault(r.search, []).append(tuple(r.key))
    for row in searches.collect():
        way = ways[row.search]
        assert len(way) - 1 == shortest(row)
        assert way[0] == tuple(row.starts[0]) and way[-1] in set(map(tuple, row.goals))
        assert all(b in crystal.neighbours(a, LABELS, DELTA) for a, b in zip(way, way[1:]))


def test_same_length_and_barrier_as_inside_a_task(searches):
    reached = bestfirst.best_first(searches, heuristic="manhattan", width=1)
    length = {r.search: r["n"] - 1 for r in bestfirst.best_paths(searches, reached).groupBy("search").agg(F.count("*").alias("n")).collect()}
    for row in searches.collect():
        found, _, path = pathfinding.a_star([tuple(k) for k in row.starts], [tuple(k) for k in row.goals], LABELS, DELTA)
        assert found and length[row.search] == len(path) - 1


def test_ceiling_keeps_points_out_and_unknown_estimates_raise(searches, spark):
    level = pathfinding.Energies(1.0, DELTA)(KEY)
    reached = bestfirst.best_first(searches, heuristic="none", width=10_000, max_steps=2, ceiling=level)
    keys = reached.filter("step > 0").select("key").distinct()
    assert keys.count() and canonical.energies_of(keys, 1.0, DELTA).filter(F.col("energy") >= level).count() == 0
    with pytest.raises(ValueError):
        bestfirst.best_first(searches, heuristic="unknown")
    assert bestfirst.best_first(searches.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bestfirst.best_first(searches.withColumn("xi", F.col("search") + 0.5))


class Lost(Exception):
    pass


def stop_after(monkeypatch, step):
    """A driver that is lost in the step behind so many."""
    plain = canonical.neighbour_keys
    calls = []

    def lost(*args, **options):
        calls.append(1)
        if len(calls) > step:
            raise Lost
        return plain(*args, **options)

    monkeypatch.setattr(canonical, "neighbour_keys", lost)
    return lambda: monkeypatch.setattr(canonical, "neighbour_keys", plain)


def test_a_lost_search_goes_on(searches, tmp_path, monkeypatch):
    rows = lambda df: sorted(map(repr, df.collect()))
    options = {"heuristic": "none", "width": 30}
    whole = rows(bestfirst.best_first(searches, **options))
    mend = stop_after(monkeypatch, 1)
    folder = f"file://{tmp_path}/search"
    with pytest.raises(Lost):
        bestfirst.best_first(searches, folder=folder, **options)
    mend()
    told = []
    assert rows(bestfirst.best_first(searches, folder=folder, listener=told.append, **options)) == whole
    assert [t["step"] for t in told][0] == 2
    with pytest.raises(ValueError):
        bestfirst.best_first(searches, folder=folder, heuristic="none", width=31)
    # a driver lost between two renames leaves a draft
    manifest = tmp_path / "search" / "manifest.json"
    manifest.rename(tmp_path / "search" / "manifest-0.json")
    for crc in (tmp_path / "search").glob(".*.crc"):
        crc.unlink()
    assert rows(bestfirst.best_first(searches, folder=folder, **options)) == whole


def test_a_lost_flood_goes_on_and_listeners_are_told(spark, tmp_path, monkeypatch):
    start = spark.createDataFrame([(list(KEY), LABELS), (list(KEY[:7]), [0])], "key array<bigint>, labels array<int>")
    none = start.select("key").limit(0)
    rows = lambda df: sorted(repr((r.key, r.labels, r.step, round(r.energy, 9))) for r in df.collect())
    options = {"width": 0.3, "batch": 20, "max_steps": 3}
    told = []
    whole = rows(canonical.flood_keys(start, none, 1.0, DELTA, listener=told.append, **options))
    assert [t["step"] for t in told] == [1, 2, 3] and all(t["floods"] == 2 for t in told)
    assert 2 + sum(t["new"] for t in told) == len(whole)
    mend = stop_after(monkeypatch, 2)
    with pytest.raises(Lost):
        canonical.flood_keys(start, none, 1.0, DELTA, folder=str(tmp_path), **options)
    mend()
    assert rows(canonical.flood_keys(start, none, 1.0, DELTA, folder=str(tmp_path), **options)) == whole
    # floods of two compositions in one go are those of each alone
    apart = [r for part in (start.filter("size(labels) = 1"), start.filter("size(labels) = 2")) for r in rows(canonical.flood_keys(part, none, 1.0, DELTA, **options))]
    assert sorted(apart) == whole


def test_lost_sweeps_and_ratchets_go_on(searches, tmp_path, monkeypatch):
    from latticegraph.operators import barrier

    few = searches.filter("search < 2")
    known = supersteps.written(barrier.run(barrier.tasks(few, max_iterations=50)), "known")
    rows = lambda df: sorted(map(repr, df.collect()))
    plain = barrier.run
    for name, call in (
        ("sweep", lambda **o: barrier.sweep(few, known, 2, 2, attempts=1, max_iterations=20, beam=100, **o).drop("path", "energies")),
        ("ratchet", lambda **o: barrier.ratchet(few, known, 0.05, rounds=3, failures=1, max_iterations=10, beam=100, **o)),
    ):
        told = []
        whole = rows(call(listener=told.append))
        assert [t["step"] for t in told] == list(range(1, len(told) + 1)) and len(told) > 1
        calls = []

        def lost(*args, **options):
            calls.append(1)
            if len(calls) > 1:
                raise Lost
            return plain(*args, **options)

        monkeypatch.setattr(barrier, "run", lost)
        with pytest.raises(Lost):
            call(folder=f"{tmp_path}/{name}")
        monkeypatch.setattr(barrier, "run", plain)
        again = []
        assert rows(call(folder=f"{tmp_path}/{name}", listener=again.append)) == whole
        assert [t["step"] for t in again] == [t["step"] for t in told][1:]
    # the ratchet reached finer resolutions
    assert max(r.adaptations for r in barrier.ratchet(few, known, 100.0, rounds=2, failures=1, max_iterations=10, beam=100).collect()) == 2


def test_a_failing_listener_loses_no_step(searches):
    def bad(metrics):
        raise RuntimeError("no")

    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        rows = bestfirst.best_first(searches, heuristic="none", width=10_000, max_steps=1, listener=bad)
        assert rows.filter("step = 1").count() > 0
    assert any("listener failed" in str(w.message) for w in seen)


def test_long_chains_take_few_joins(spark, monkeypatch):
    n = 1001
    rows = [(k, k - 1 if k else None) for k in range(n)] + [(5000 + k, 4999 + k if k else None) for k in range(7)]
    links = spark.createDataFrame(rows, "id long, parent long").repartition(4)
    writes, plain = [], supersteps.written
    monkeypatch.setattr(supersteps, "written", lambda df, name="step": writes.append(name) or plain(df, name))
    got = search.paths_to(links, spark.createDataFrame([(1000,), (5006,), (0,), (700,)], "id long")).collect()
    assert len(writes) < 25
    want = {(g, h, g - h) for g in (1000, 0, 700) for h in range(g + 1)} | {(5006, h, 5006 - h) for h in range(7)}
    assert {(r.goal, r.hop, r.id) for r in got} == want and len(got) == len(want)
