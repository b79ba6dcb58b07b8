"""Rows that ask for the same work: it is done once, however many of them there are."""

import pytest
from pyspark.sql import functions as F

from latticegraph.functions import crystal
from latticegraph.operators import barrier, bestfirst, canonical, continuous, motifs
from latticegraph.plans import crystal_queries, function_queries, partition_queries

KEY = crystal.canonical_key([9, 10, 12, 31, 19, 21, 22], [[0, 0, 0], [3, 1, 4]], [0, 1], 8)


@pytest.fixture
def handed(monkeypatch, spark):
    """Counts of the rows that go into Python functions, in the order in which the plans are made."""
    out, frame = [], type(spark.range(1))
    for name in ("mapInPandas", "mapInArrow"):
        plain = getattr(frame, name)

        def counted(self, *args, _plain=plain, **more):
            out.append(self.count())
            return _plain(self, *args, **more)

        monkeypatch.setattr(frame, name, counted)
    return out


def test_sublattices_are_looked_at_once_for_all_parts(spark, tmp_path, handed):
    spark.range(500).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    rows = function_queries.wave_vectors(spark, str(tmp_path))
    many = {1: 1, 2: 7, 3: 13, 4: 35}
    assert rows.filter("back").count() == rows.distinct().count() == sum(many[(k % 50 + 1) % 4 + 1] for k in range(500))
    assert handed == [1 + 7 + 13 + 35]


def test_equal_searches_run_once_unless_dropout_tells_them_apart(spark, handed):
    goal = crystal.neighbours(KEY, [0, 1], 8)[0]
    rows = [(k, [list(KEY)], [list(goal)], [0, 1], 1.0, 8) for k in range(20)] + [(20, [list(goal)], [list(KEY)], [0, 1], 1.0, 8)]
    searches = spark.createDataFrame(rows, barrier.SEARCH)
    found = barrier.run(barrier.tasks(searches)).collect()
    assert sorted(r.search for r in found) == list(range(21)) and all(r.found and r.attempt == 0 for r in found)
    assert all(r.path == ([list(KEY), list(goal)] if r.search < 20 else [list(goal), list(KEY)]) for r in found)
    barrier.run(barrier.tasks(searches, dropout=0.1))
    assert handed == [2, 21]


def test_equal_paths_and_equal_crystals_are_worked_on_once(spark, handed):
    keys = [list(KEY), list(crystal.neighbours(KEY, [0, 1], 8)[0])]
    paths = spark.createDataFrame([(k, keys, [0, 1], 1.0, 8) for k in range(5)], "path long, keys array<array<bigint>>, labels array<int>, xi double, delta int")
    band = continuous.elastic_bands(paths, images=3, max_steps=2).collect()
    assert sorted((r.path, r.image) for r in band) == [(k, i) for k in range(5) for i in range(3)]
    assert sorted((r.path, r.step) for r in continuous.aligned_paths(paths).collect()) == [(k, i) for k in range(5) for i in range(2)]
    cell = [[3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0]]
    crystals = spark.createDataFrame([(k, cell, [0.0, 0.0, 0.0], [0]) for k in range(7)], "id long, cell array<array<double>>, fractions array<double>, labels array<int>")
    assert sorted(r.id for r in continuous.relax_cells(crystals, max_steps=3).collect()) == list(range(7))
    assert handed == [1, 1, 1]


def test_spread_rows_stay_apart_after_distinct(spark):
    rows = canonical.spread(spark.range(200).select("id").distinct(), "id")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_large_search_expands_equal_searches_once(spark, monkeypatch):
    goal, asked, plain = list(crystal.neighbours(KEY, [0, 1], 8)[0]), [], bestfirst.best_first
    rows = [(k, [list(KEY)], [goal], [0, 1], 1.0, 8) for k in (3, 5, 9)] + [(4, [goal], [list(KEY)], [0, 1], 1.0, 8)]
    searches = spark.createDataFrame(rows, barrier.SEARCH)
    monkeypatch.setattr(crystal_queries, "_searches", lambda *_: searches)
    monkeypatch.setattr(bestfirst, "best_first", lambda rows, **more: asked.append(sorted(r.search for r in rows.collect())) or plain(rows, **more))
    found = crystal_queries.large_search(spark, "").collect()
    assert sorted((r.search, r.step) for r in found) == [(k, step) for k in (3, 4, 5, 9) for step in (0, 1)]
    assert asked == [[3, 4]]


def test_equal_motifs_get_their_form_once(spark, handed):
    rows = [(k, [1, 0], [0.1 * (k % 2), 0.0, 0.0, 0.5, 0.5, 0.5]) for k in range(20)] + [(30, [0], None), (31, [1, 0], [0.0] * 6)]
    crystals = spark.createDataFrame(rows, "id long, labels array<int>, coords array<double>")
    classes = {r.id: r["class"] for r in motifs.motif_classes(crystals).collect()}
    assert classes == {k: k % 2 for k in range(20)} | {31: 31}
    assert handed == [4]
    motifs.motif_matches(crystals, 0.1)
    assert max(handed) == 4


def _few_crystals(spark, folder):
    spark.createDataFrame([(7 if k % 3 else 11, 4) for k in range(30)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_equal_crystals_are_rebuilt_once_for_a_resolution(spark, tmp_path, handed):
    rows = partition_queries.neighbours_by_resolution(spark, _few_crystals(spark, tmp_path)).collect()
    assert handed == [2 * 4] and [r.n for r in rows] == [30] * 4


def test_flooded_keys_are_found_once(spark, tmp_path, handed):
    rows = partition_queries.partitioned_flood(spark, _few_crystals(spark, tmp_path))
    assert handed[0] == 2 and rows.filter("step = 0").count() == 2


def test_attempts_between_the_same_ends_share_neighbours(monkeypatch, spark):
    goal = crystal.neighbours(KEY, [0, 1], 8)[0]
    rows = [(k, [list(KEY)], [list(goal)], [0, 1], 1.0, 8) for k in range(6)] + [(6, [list(goal)], [list(KEY)], [0, 1], 1.0, 8)]
    seen, frame = [], type(spark.range(1))
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, *a: seen.append((f, self.toPandas())) or frame.mapInArrow(self, lambda b: b, self.schema))
    try:
        barrier.run(barrier.tasks(spark.createDataFrame(rows, barrier.SEARCH), dropout=0.1))
    except Exception:  # the plan has other columns here
        pass
    each, table = seen[0]
    asked, plain = [], crystal.neighbours
    monkeypatch.setattr(crystal, "neighbours", lambda key, *a: asked.append(key) or plain(key, *a))
    found = [r for part in each(iter([table])) for r in part.itertuples()]
    assert len(found) == 7 and all(r.found for r in found)
    assert sorted(asked) == sorted(set(asked))
