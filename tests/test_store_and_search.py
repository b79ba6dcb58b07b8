"""Store operators, graph search and the mailbox on small graphs, and every registered query on the small tables."""

import datetime
import random
from collections import deque

import duckdb
import pytest

import __spark_entry__
from latticegraph import registry
from latticegraph.operators import search, store
from latticegraph.streaming import mailbox

DATA = "/root/testdata/sf0.001"


def graph(spark, n=60, m=140, seed=1):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return edges, store.neighbours(spark.createDataFrame(edges, "src long, dst long"))


def adjacency(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def test_rings_are_breadth_first(spark):
    edges, pairs = graph(spark)
    near, todo, depth = adjacency(edges), deque([0]), {0: 0}
    while todo:
        a = todo.popleft()
        for b in near.get(a, ()):
            if b not in depth:
                depth[b] = depth[a] + 1
                todo.append(b)
    got = {r.id: r.ring for r in search.rings(pairs, spark.range(1), 4).collect()}
    assert got == {k: d for k, d in depth.items() if d <= 4}


def test_flood_takes_the_lowest_and_paths_follow_edges(spark):
    edges, pairs = graph(spark)
    near, rng = adjacency(edges), random.Random(4)
    energy = {k: float(rng.randrange(1000)) for k in range(60)}
    energies = spark.createDataFrame(list(energy.items()), "id long, energy double")
    goal = max(near, key=lambda k: (k not in near[0] and k != 0, energy[k]))
    # brute force: open the lowest until the goal is seen
    seen, opened = {0}, {0}
    while goal not in seen and opened:
        low = min(opened, key=lambda k: (energy[k], k))
        opened.remove(low)
        fresh = near[low] - seen
        seen |= fresh
        opened |= fresh
    got = search.flood(pairs, energies, spark.range(1), spark.range(goal, goal + 1), batch=1, max_steps=200)
    assert {r.id for r in got.collect()} == seen
    hops = [r.id for r in search.path_to(got, goal).orderBy("hop").collect()]
    assert hops[0] == goal and hops[-1] == 0 and all(b in near[a] for a, b in zip(hops, hops[1:]))
    assert search.barrier(got).first().barrier == max(energy[k] for k in seen)


def test_upsert_insert_and_order(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    news = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "id long, v string, seq long")
    assert sorted(map(tuple, store.upsert(table, news, ["id"], "seq").collect())) == [(1, "a"), (2, "d"), (3, None)]
    assert sorted(store.insert_missing(table, news.select("id", "v"), ["id"]).select("id").collect()) == [(1,), (2,), (3,)]
    wanted = spark.createDataFrame([(0, 2), (1, 1), (2, 2)], "pos int, id long")
    assert [r.v for r in store.points_by_keys(table, wanted).collect()] == ["b", "a", "b"]
    with pytest.raises(KeyError):
        store.points_by_keys(table, spark.createDataFrame([(0, 9)], "pos int, id long"))


def test_mailbox_stream_equals_batch(spark, tmp_path):
    rows = [(k % 7, datetime.datetime(2024, 1, 1, k % 5, k)) for k in range(40)]
    box = spark.createDataFrame(rows, "key long, at timestamp")
    box.write.parquet(str(tmp_path / "in"))
    stream = mailbox.first_arrivals(spark.readStream.schema(box.schema).parquet(str(tmp_path / "in")), "key", "at", "10 hours")
    run = stream.writeStream.format("memory").queryName("mail").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert {r.key for r in spark.table("mail").collect()} == {r.key for r in mailbox.first_arrivals(box, "key", "at").collect()} == set(range(7))


def _cell(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([_cell(v) for v in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in registry.ORACLE_SQL:
        other = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(other.columns) == cols
        at = [other.columns.index(c) for c in cols]
        assert sorted(_cell(list(r)) for r in rows) == sorted(_cell([r[k] for k in at]) for r in other.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
