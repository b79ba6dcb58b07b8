"""The cif format, bucketed tables, table functions, the mailbox with state, and motifs that match."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticegraph.functions import crystal
from latticegraph.operators import canonical, motifs, store, tablefunctions
from latticegraph.sources import bucketed, cif, cif_source
from latticegraph.streaming import mailbox

# ---------------------------------------------------------------- cif

ROW = "structure_id string, a double, b double, c double, alpha double, beta double, gamma double, formula string, atoms array<struct<element: string, x: double, y: double, z: double, occupancy: double>>"


def structures(spark, names):
    rows = [(n, 3.0 + k, 4.0, 5.0, 90.0, 91.0, 120.0, "Zr O" if k % 2 else None, [("Zr", 0.0, 0.25, 0.5, 1.0), ("O", 0.125, k / 7, 0.0, 0.5)]) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, ROW)


def same(a, b):
    pick = lambda df: sorted((r.structure_id, round(r.a, 6), r.gamma, r.formula or "", [(x.element, round(x.y, 6), x.occupancy) for x in r.atoms]) for r in df.collect())
    assert pick(a) == pick(b)


def test_files_come_back_and_names_prune(spark, tmp_path):
    cif_source.register(spark)
    folder = f"{tmp_path}/crystals"
    want = structures(spark, [f"{p}{k}" for p in "ab" for k in range(12)]).repartition(3)
    want.write.format("cif").mode("append").save(folder)
    assert len(list((tmp_path / "crystals").rglob("*.cif"))) == 24 and not (tmp_path / "crystals" / "_drafts").exists()
    same(spark.read.format("cif").load(folder), want)
    for row, text in zip(want.orderBy("structure_id").collect(), cif.text(want).orderBy("structure_id").collect()):
        assert cif.text_of(row.asDict(recursive=True)) == text.text
    # a file that cannot be read is not opened where its name does not fit
    (tmp_path / "crystals" / "c1.cif").write_text("data_broken")
    rows = lambda names="*": spark.read.format("cif").option("names", names).load(folder)
    same(rows("a*"), want.filter(F.col("structure_id").startswith("a")))
    same(rows("a1, b2"), want.filter("structure_id in ('a1', 'b2')"))
    some = rows("b*")
    assert some.filter("structure_id = 'b3'").count() == 1 and some.count() == 12 and rows("none").count() == 0
    with pytest.raises(Exception, match="missing"):
        rows().collect()


def test_packed_files_come_back_and_names_prune(spark, tmp_path):
    cif_source.register(spark)
    folder = f"{tmp_path}/packed"
    want = structures(spark, [f"{p}{k}" for p in ("a", "b", "-", "%", "1 data_") for k in range(12)]).repartition(3)
    want.write.format("cif").option("packed", "true").mode("append").save(folder)
    assert len(list((tmp_path / "packed").rglob("*.cif*"))) <= 15
    rows = lambda names="*": spark.read.format("cif").option("names", names).load(folder)
    same(rows(), want)
    (tmp_path / "packed" / "000000-c.cifs").write_text("data_c1\nbroken\n")
    for p in "ab-%1":
        same(rows(f"{p}*"), want.filter(F.col("structure_id").startswith(p)))
    same(rows("a1, b2"), want.filter("structure_id in ('a1', 'b2')"))
    with pytest.raises(Exception, match="missing"):
        rows().collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    cif_source.register(spark)
    folder = tmp_path / "out"
    bad = structures(spark, ["x1", "x2", "no/name"]).repartition(3)
    with pytest.raises(Exception, match="no name"):
        bad.write.format("cif").mode("append").save(str(folder))
    assert not folder.exists() or not list(folder.rglob("*"))
    structures(spark, ["x1", "x2"]).write.format("cif").mode("append").save(str(folder))
    with pytest.raises(Exception, match="no name"):
        bad.write.format("cif").mode("overwrite").save(str(folder))
    assert sorted(p.stem for p in folder.rglob("*.cif")) == ["x1", "x2"]
    structures(spark, ["y"]).write.format("cif").mode("overwrite").save(str(folder))
    assert [p.stem for p in folder.rglob("*.cif")] == ["y"]
    with pytest.raises(Exception, match="(?i)not"):
        spark.read.format("cif").load(f"{tmp_path}/nowhere").collect()


# ---------------------------------------------------------------- bucketed tables


def test_bucketed_joins_move_nothing_and_agree(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(k, float(k % 17)) for k in range(200)], "id long, energy double")
    edges = spark.createDataFrame([(rng.randrange(200), rng.randrange(260)) for _ in range(900)], "src long, dst long")
    status = spark.createDataFrame([(k, 1, rng.choice(["OPEN", "CLOSED"])) for k in range(0, 220, 2)], "id long, search int, status string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    held = bucketed.BucketedStore.create(spark, "points_for_test", points, edges, status, buckets=8)
    try:
        with pytest.raises(ValueError):
            bucketed.BucketedStore.create(spark, "points_for_test", points, edges, status)
        pairs, marked = store.neighbours(edges), lambda s: status.filter(f"status = '{s}'")
        ids = pairs.select("id").distinct()
        want = {
            "neighbours": pairs,
            "neighbour_keys": store.neighbour_keys(edges, points),
            "foreign_neighbours": edges.distinct().join(points.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"),
            "points_with": store.status_points(status, points, "OPEN"),
            "membership": ids.join(marked("OPEN").select("id"), "id", "left_semi"),
            "new_frontier": ids.join(marked("CLOSED").select("id"), "id", "left_anti"),
            "unseen": ids.join(status.select("id"), "id", "left_anti"),
            "degrees": pairs.groupBy("id").agg(F.count("*").alias("degree")),
        }
        options = {"points_with": ("OPEN",), "membership": ("OPEN",), "unseen": (held.table("status"),)}
        for name, rows in want.items():
            got = getattr(held, name)(*options.get(name, ()))
            assert sorted(map(repr, got.select(*rows.columns).collect())) == sorted(map(repr, rows.collect())), name
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString(), name
        held.add("status", spark.createDataFrame([(999, 1, "OPEN")], "id long, search int, status string"))
        assert held.points_with("OPEN").filter("id = 999").count() == 1
        with pytest.raises(ValueError):
            held.table("none")
    finally:
        held.drop()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ---------------------------------------------------------------- table functions


def test_neighbours_in_sql(spark):
    rows = [(list(crystal.canonical_key(v, [[0, 0, 0], [3, 1, k]], [0, 1], 8)), [0, 1]) for k, v in enumerate(([9, 10, 12, 31, 19, 21, 22], [5, 6, 7, 18, 11, 12, 13]))]
    rows += [(list(rows[0][0][:7]), [0]), (None, [0, 1])]
    keys = spark.createDataFrame(rows, "key array<bigint>, labels array<int>")
    want = sorted(map(repr, canonical.neighbour_keys(keys, 8).select("key", "neighbour").collect()))
    tablefunctions.register(spark)
    lateral = spark.sql("SELECT k.key, n.neighbour FROM {k} k, LATERAL neighbours(k.key, k.labels, 8) n", k=keys)
    assert sorted(map(repr, lateral.collect())) == want
    batch = spark.sql("SELECT key, neighbour FROM neighbours_of(TABLE({k}))", k=keys.withColumn("delta", F.lit(8)))
    assert sorted(map(repr, batch.collect())) == want


# ---------------------------------------------------------------- mailbox


def test_a_restarted_mailbox_loses_nothing_and_takes_keys_once(spark, tmp_path, monkeypatch):
    inbox, folder, schema = tmp_path / "inbox", f"file://{tmp_path}/box", "key string, letter long"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{inbox}/{name}")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{inbox}/*")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    put("a", [("x", 5), ("x", 3), ("y", 7), (None, 1), ("z", None)])
    assert rows_of(mailbox.deliver(stream(), "key", "letter", folder)) == [("x", 3), ("y", 7)]
    put("b", [("x", 1), ("z", 2)])
    # the sink fails before the batch is marked as done
    plain, calls = mailbox.DataFrame.write.fget, []

    def fails(self):
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(type(spark.range(0)), "write", property(fails))
    with pytest.raises(Exception, match="lost"):
        mailbox.deliver(stream(), "key", "letter", folder)
    monkeypatch.undo()
    assert calls and plain
    assert rows_of(mailbox.deliver(stream(), "key", "letter", folder)) == [("x", 3), ("y", 7), ("z", 2)]
    assert rows_of(mailbox.deliver(stream(), "key", "letter", folder)) == [("x", 3), ("y", 7), ("z", 2)]


# ---------------------------------------------------------------- motifs


def brute_matches(rows, tolerance):
    out = set()
    for (a, la, xa), (b, lb, xb) in itertools.combinations(sorted(rows), 2):
        if sorted(la) != sorted(lb):
            continue
        xa, xb = np.array(xa).reshape(-1, 3), np.array(xb).reshape(-1, 3)
        anchor = min(set(la), key=lambda x: (la.count(x), x))
        for o, p in itertools.product(range(len(la)), repeat=2):
            if la[o] != anchor or lb[p] != anchor:
                continue
            for order in itertools.permutations(range(len(lb))):
                d = (xa - xa[o]) - (xb - xb[p])[list(order)]
                if order[o] == p and [lb[k] for k in order] == list(la) and (np.abs(d - np.rint(d)) <= tolerance + 1e-9).all():
                    out.add((a, b))
    return out


def test_planted_shifts_are_found_and_near_misses_refused(spark):
    rng = np.random.default_rng(4)
    rows, planted, tolerance = [], set(), 0.03
    for k in range(40):
        n = int(rng.integers(1, 5))
        labels = sorted(rng.integers(0, 2, n).tolist())
        at = rng.random((n, 3))
        rows.append((10 * k, labels, at.ravel().tolist()))
        order = rng.permutation(n)
        moved = at + rng.random(3)
        rows.append((10 * k + 1, [labels[i] for i in order], moved[order].ravel().tolist()))  # the same, shifted
        near = moved + rng.uniform(-tolerance / 2, tolerance / 2, (n, 3))
        rows.append((10 * k + 2, [labels[i] for i in order], near[order].ravel().tolist()))
        far = moved.copy()
        far[-1, 0] += 3 * tolerance if n > 1 else 0
        rows.append((10 * k + 3, labels, far.ravel().tolist()))
        if n > 1:
            planted.add((10 * k, 10 * k + 2))
    df = spark.createDataFrame([*rows, (990, None, [0.0] * 3), (991, [0], None), (992, [], [])], "id long, labels array<int>, coords array<double>").repartition(4)
    classes = dict(map(tuple, motifs.motif_classes(df).collect()))
    assert set(classes) == {r[0] for r in rows} and all(classes[10 * k + 1] == classes[10 * k] for k in range(40))
    got = {tuple(r) for r in motifs.motif_matches(df, tolerance).collect()}
    heads = [r for r in rows if classes[r[0]] == r[0]]
    assert got == brute_matches(heads, tolerance) and planted <= got
    assert motifs.motif_matches(df.limit(0), tolerance).count() == 0
