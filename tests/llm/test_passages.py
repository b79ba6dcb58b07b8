"""Near-duplicate passages: recall under edits, extents between any two holders, and the chain against brute force."""

import itertools
import random

import numpy as np
import pytest

from latticegraph.llm import substring

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, passage, kind):
    out = list(passage)
    for _ in range(max(1, len(passage) // 60) if kind != "exact" else 0):
        at = rng.randrange(5, len(out) - 5)
        if kind == "substituted":
            out[at] = "zz"
        elif kind == "inserted":
            out.insert(at, "zz")
        else:
            del out[at]
    return out


def test_recall_of_edited_passages(spark):
    rng = random.Random(5)
    rows, planted = [], {}
    for kind in ("exact", "substituted", "inserted", "deleted"):
        for _ in range(60):
            n, passage = len(rows), words(rng, rng.randint(60, 120))
            rows += [(n, words(rng, 60) + passage + words(rng, 40)), (n + 1, words(rng, 30) + edited(rng, passage, kind) + words(rng, 80))]
            planted.setdefault(kind, []).append((n + 1, n))
    got = {(r.doc_id, r.source_doc_id): r for r in substring.duplicate_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()}
    for kind, pairs in planted.items():
        assert sum(p in got for p in pairs) >= (0.98 if kind == "exact" else 0.9) * len(pairs), kind
    assert set(got) <= set(itertools.chain(*planted.values()))
    for r in got.values():
        own, other = rows[r.doc_id][1], rows[r.source_doc_id][1]
        assert 0 <= r.start_word and r.end_word <= len(own) and r.source_end <= len(other)
        grams = [{tuple(w[k : k + 5]) for k in range(a, b - 4)} for w, a, b in ((own, r.start_word, r.end_word), (other, r.source_start, r.source_end))]
        assert abs(len(grams[0] & grams[1]) / len(grams[0] | grams[1]) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_any_two_holders_and_copies(spark):
    rng = random.Random(6)
    p = words(rng, 110)
    own = {1: words(rng, 70) + p[:60] + words(rng, 30), 2: words(rng, 40) + p + words(rng, 20), 3: words(rng, 60) + p + words(rng, 10)}
    rows = [*own.items(), (9, own[2]), (12, own[2]), (13, words(rng, 40)), (14, None), (15, "")]
    rows = [(i, " ".join(w) if isinstance(w, list) else w) for i, w in rows] + [(20, rows[5][1] and " ".join(rows[5][1]))]
    got = {(r.doc_id, r.source_doc_id): (r.start_word, r.end_word) for r in substring.duplicate_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 1): (40, 100), (3, 1): (60, 120), (3, 2): (60, 170), (9, 2): (0, 170), (12, 2): (0, 170)}


def test_predecessors_over_batches():
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted({(rng.randrange(6), rng.randrange(8), rng.randrange(50)) for _ in range(150)})
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), *(pa.array([r[2] for r in part], pa.int32()) for _ in range(3))], ["signature", "key", "c", "l", "r"]) for part in (rows[k : k + size] for k in range(0, len(rows), size))]
        got = [(x["signature"], x["key"], x["c"], x["source"], x["sc"]) for b in substring._previous(iter(batches)) for x in b.to_pylist()]
        want = []
        for s, k, c in rows:
            earlier = [r for r in rows if r[0] == s and r[1] < k]
            if earlier:
                want.append((s, k, c, earlier[-1][1], earlier[-1][2]))
        assert got == want


@pytest.mark.parametrize("size", [10**6, 15])
def test_chains_are_increasing_and_long(size):
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.integers(0, size, 160).astype(np.uint64)
        b = np.concatenate([rng.integers(0, size, 9).astype(np.uint64), a[:70], [np.uint64(size + 1)], a[70:]])
        i, j = substring.chain(a, b)
        assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all() and (a[i] == b[j]).all()
        assert len(i) == 160 or size == 15
    assert len(substring.chain(a, a[:0])[0]) == 0 and len(substring.chain(a[:0], a)[0]) == 0


def test_similar_parts_of_a_bridged_stretch():
    a = np.arange(72, dtype=np.uint64)
    b = a.copy()
    b[56:70] += np.uint64(1000)  # 60 equal words, 10 different, 6 equal
    assert [m[:4] for m in substring.matching_stretches(a, b)] == [(0, 56, 0, 56)]
    rng = np.random.default_rng(4)
    for _ in range(12):
        b = rng.permutation(10_000)[:130].astype(np.uint64)
        a = b.copy()
        for at in rng.integers(0, 126, rng.integers(3, 9)):
            a[at : at + 5] = rng.integers(20_000, 30_000, 5)
        found = [m[:2] for m in substring.matching_stretches(a, b)]
        same, ok = a == b, []
        for p in range(130):
            for q in range(p + substring.WINDOW, 131):
                at = np.flatnonzero(same[p:q])
                x, y = set(a[p:q].tolist()), set(b[p:q].tolist())
                if len(at) and at[0] == 0 and at[-1] == q - p - 1 and (np.diff(at) <= substring.GAP + substring.SHINGLE).all() and len(x & y) >= 0.8 * len(x | y):
                    ok.append((p, q))
        assert sorted(found) == [(p, q) for p, q in ok if not any((u, v) != (p, q) and u <= p and q <= v for u, v in ok)]


def test_every_similar_pair_is_linked_or_in_linked_classes(spark):
    """Against brute force over all pairs, with a common line inside the passages and other documents between their holders."""
    rng = random.Random(11)
    line, rows = words(rng, 36), {}
    order = rng.sample(range(150), 150)
    for k in range(25):
        own = words(rng, 24)
        passage = own[:8] + line + own[8:]
        for place, kind in zip(order[2 * k : 2 * k + 2], ("exact", "substituted" if k % 2 else "inserted")):
            rows[place] = words(rng, 25) + (edited(rng, passage, kind) if kind != "exact" else passage) + words(rng, 25)
    chain, passage = sorted(order[50:56]), words(rng, 90)
    for place in chain:
        rows[place] = words(rng, 20) + passage + words(rng, 20)
        passage = edited(rng, passage, "substituted")
    for place in order[56:]:
        rows[place] = words(rng, 20) + line + words(rng, 20)
    text = {i: " ".join(w) for i, w in rows.items()}
    shingles = {}
    for i, w in rows.items():
        hashes = np.array([hash(x) for x in w], np.int64).view(np.uint64)
        shingles[i] = substring.shingle_hashes(hashes, substring.SHINGLE)
    want = {(i, j) for j, i in itertools.combinations(sorted(rows), 2) if any(True for _ in substring.matching_stretches(shingles[i], shingles[j]))}
    assert len(want) > 30
    got = {(r.doc_id, r.source_doc_id) for r in substring.duplicate_passages(spark.createDataFrame(list(text.items()), SCHEMA)).collect()}
    assert want == got


def classes_of(pairs):
    head = {}
    find = lambda x: x if head.get(x, x) == x else find(head[x])
    for pair in pairs:
        low, high = sorted(map(find, pair))
        head[high] = low
    return {(x, find(x)) for x in head if find(x) != x}


def test_classes_are_those_of_all_similar_pairs(spark, monkeypatch):
    """Against brute force over all pairs: edited copies, chains of edits, a common line, runs of one word; and no more is compared than grows with the rows."""
    rng = random.Random(12)
    passage, line, texts = words(rng, 90), words(rng, 36), []
    for _ in range(60):
        texts.append(words(rng, 20) + edited(rng, passage, rng.choice(("substituted", "inserted", "deleted"))) + words(rng, 20))
    for kind in ("exact", "substituted", "inserted") * 4:
        own = words(rng, 24)
        own = own[:8] + line + own[8:]
        texts += [words(rng, 25) + own + words(rng, 25), words(rng, 25) + edited(rng, own, kind) + words(rng, 25)]
    moved = words(rng, 80)
    for _ in range(8):
        texts.append(words(rng, 20) + moved + words(rng, 20))
        moved = edited(rng, moved, "substituted")
    texts += [words(rng, 20) + line + words(rng, 20) for _ in range(40)]
    texts += [words(rng, 30) + ["of"] * n + ["and"] * m + words(rng, 30) for n, m in ((30, 10), (30, 30), (49, 5), (60, 5), (140, 0), (20, 51), (33, 31))]
    rng.shuffle(texts)
    shingles = [substring.shingle_hashes(np.array([hash(x) for x in w], np.int64).view(np.uint64), substring.SHINGLE) for w in texts]
    pairs = [(j, i) for j, i in itertools.combinations(range(len(texts)), 2) if any(True for _ in substring.matching_stretches(shingles[i], shingles[j]))]
    compared, real = [], substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, name: [out := real(df, name), name == "candidates" and compared.append(out.count())][0])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, " ".join(texts[3])), (901, "of " * 9), (902, "of " * 9), (903, None)], SCHEMA)
    got = substring.passage_classes(docs).collect()
    assert {(r.doc_id, r.class_id) for r in got} == classes_of([*pairs, (3, 900)]) and len(got) == len({r.doc_id for r in got})
    assert len(pairs) > 1500 and sum(compared) < 4 * len(texts)
    for r in got:
        own, other = texts[r.doc_id % 897], texts[r.source_doc_id % 897]
        assert 50 <= r.end_word - r.start_word and r.end_word <= len(own) and 50 <= r.source_end - r.source_start and r.source_end <= len(other)


def test_classes_of_odd_tables(spark):
    rng = random.Random(13)
    p = " ".join(words(rng, 90))
    rows = [(5, p), (5, p), (None, p + " tail"), (9, p), (7, "x"), (7, p + " end")]
    got = {(r.doc_id, r.class_id) for r in substring.passage_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, None), (7, None), (9, None)}
    named = spark.createDataFrame([("a", p), ("b", p + " tail")], "`key` string, `owner` string")
    assert [tuple(r)[:2] for r in substring.passage_classes(named, id_col="key", text_col="owner").collect()] == [("b", "a")]
    assert substring.passage_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cyclic_windows():
    rng = np.random.default_rng(8)
    sh = np.concatenate([rng.integers(1, 9**9, 30), np.full(60, 7), np.tile([4, 5, 6], 19), [0, 0], np.full(50, 7), [0], np.tile(rng.integers(1, 99, substring.CYCLE + 1), 4), np.tile([5, 6, 4], 16), np.full(45, 3)]).astype(np.uint64)
    at, hashes = substring.cyclic_windows(sh)
    windows = {k: tuple(sh[k : k + substring.WINDOW].tolist()) for k in range(len(sh) - substring.WINDOW + 1)}
    want = {k: w for k, w in windows.items() if 0 not in w and any(w[t:] == w[:-t] for t in range(1, substring.CYCLE + 1))}
    assert at.tolist() == sorted(want) and len(want) > 30
    assert len(set(hashes.tolist())) == len(set(want.values())) == len(set(zip(hashes.tolist(), want.values())))
    assert not len(substring.cyclic_windows(sh[:45])[0])


def test_runs_of_one_word_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(14)
    texts = [words(rng, 30) + ["of"] * n + words(rng, 30) for n in range(50, 120)] + [words(rng, 30) + ["of"] * n + words(rng, 30) for n in range(40, 50)]
    made, real = [], substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, name: [out := real(df, name), name in ("class-pairs", "candidates") and made.append(out.count())][0])
    got = substring.passage_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], SCHEMA)).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, 0) for i in range(1, 70)}
    assert sum(made) < 4 * len(texts)


def test_classes_that_may_be_similar_are_found_in_any_blocks(spark, monkeypatch):
    """Near copies with many edits: a class is what all similar pairs lead to, whatever the blocks; few pairs that are not similar are verified."""
    rng = random.Random(15)
    base, texts = words(rng, 160), []
    for _ in range(90):
        copy = list(base)
        for at in sorted(rng.sample(range(5, 155), rng.randrange(4, 11)), reverse=True):
            copy[at : at + rng.randrange(2)] = words(rng, rng.randrange(3))
        texts.append(copy)
    shingles = [substring.shingle_hashes(np.array([hash(x) for x in w], np.int64).view(np.uint64), substring.SHINGLE) for w in texts]
    pairs = [(j, i) for j, i in itertools.combinations(range(len(texts)), 2) if any(True for _ in substring.matching_stretches(shingles[i], shingles[j]))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], SCHEMA)
    assert len(classes_of(pairs)) > 30
    for block in ((128, 512), (2, 3)):
        monkeypatch.setattr(substring, "BLOCK", block)
        assert {(r.doc_id, r.class_id) for r in substring.passage_classes(docs).collect()} == classes_of(pairs)
