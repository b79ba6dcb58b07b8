"""Token files, change points and alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticegraph.llm import alignment, changepoints, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "The quick brown fox jumps over the lazy dog, twice.", "Grüße aus Köln — naïve café ✓ 漢字かな 😀", "  two  spaces\n\nand\tlines ", "<|endoftext|> and <s> stay plain </s>",
    "x" * 3000, "ab" * 2500 + " tail", "▁ a sign of its own", "<0x41>", "", None, "The quick brown fox", "0123456789 " * 300, "\u0000 nul", "é" * 700, " ",
]


def documents(spark, extra=0):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choice(["alpha", "beta", "gamma", "ünd", "漢字", "x1"]) for _ in range(rng.randrange(60)))) for k in range(extra)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# ---------------------------------------------------------------- token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=60))
def test_codes_come_back(values):
    values = np.array(values, np.uint32)
    control, data = tokenfile.pack(values)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
    assert (tokenfile.unpack(control, data, len(values)) == values).all()


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_long_texts_are_encoded_at_once_but_for_very_long_runs():
    from latticegraph.llm import bpe

    t = bpe.TreeBpe(BPE)
    text = "Ein Satz, it's 12 <|endoftext|>  \n\n\u00e9t\u00e9! " * 400
    for long, halved in ((text, False), (text + "x" * 5000 + " " + text, True), (text + " " * 5000 + text, True)):
        t.joins = t.token_joins = t.windows = 0
        got = list(t.encode_array(long))
        assert (t.joins + t.token_joins + t.windows > 0) == halved
        assert got == t.encode(long)



@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_files_give_the_ids_of_the_library(spark, block):
    rows, docs = documents(spark, 60)
    folder = tokenfile.write_tokens(docs, BPE, block=block)
    at, want, full = 0, [], {}
    for (k, _), ids in zip(sorted(rows), library_ids([t for _, t in sorted(rows)])):
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        full[k] = ids
        at += len(ids)
    assert sorted(map(tuple, tokenfile.file_digests(spark, folder).collect())) == want
    assert {r.doc_id: r.ids for r in tokenfile.read_tokens(spark, folder).collect()} == full
    ranks = [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    counts = Counter(i for ids in full.values() for i in ids)
    assert ranks == sorted(range(len(ranks)), key=lambda i: (-counts[i], i))


def test_files_of_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (7, "same"), (7, "same"), (7, "other text"), (3, "")]
    wide = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id int, text string, `id` string, `check` int").repartition(4)
    got = sorted(map(tuple, tokenfile.file_digests(spark, tokenfile.write_tokens(wide, BPE)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 3, 7, 7, 7]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert sorted(r[2] for r in got) == sorted(len(x) for x in library_ids([t for _, t in rows]))
    empty = tokenfile.file_digests(spark, tokenfile.write_tokens(wide.limit(0), BPE))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    # one id in most rows
    many = spark.range(3000).selectExpr("1L AS doc_id", "concat('row ', id % 3) AS text")
    starts = sorted(r.start for r in tokenfile.file_digests(spark, tokenfile.write_tokens(many, BPE, block=64)).collect())
    assert len(set(starts)) == 3000 and starts[0] == 0


# ---------------------------------------------------------------- change points


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(-3, 3), st.integers(0, 10**6)), min_size=1, max_size=20), st.sampled_from([0, 1, 700, 10_000]), st.sampled_from([2, 3, 5]))
def test_search_equals_every_cutting(values, penalty, shortest):
    assert changepoints.Series(values, shortest, penalty).solve() == changepoints.brute_force(values, shortest, penalty)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2]), min_size=10, max_size=24))
def test_ties(values):
    """Few distinct values give many equal costs."""
    assert changepoints.Series(values, 5, 100).solve() == changepoints.brute_force(values, 5, 100)


def test_bounds_are_below_the_best_costs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        values = rng.integers(0, 10 ** int(rng.integers(1, 6)), int(rng.integers(5, 60)))
        values[: len(values) // 2] //= 50
        bounds = changepoints.Series(values).first_bounds()
        assert all(bounds[e] <= changepoints.Series(values[:e]).solve()[0] for e in range(1, len(values) + 1))


def test_large_numbers_and_long_series():
    assert changepoints.Series([0] * 9 + [10**18] * 9 + [5, 10**18] * 3).solve() == changepoints.brute_force([0] * 9 + [10**18] * 9 + [5, 10**18] * 3)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, s, 150) for s in (10, 10_000, 100)])
    long = changepoints.Series(values)
    table, changepoints.TABLE = changepoints.TABLE, 1000
    try:
        assert long.table is None and long.solve() == changepoints.Series(values).solve()
    finally:
        changepoints.TABLE = table


def test_segments_of_a_table(spark):
    rng = random.Random(2)
    rows = [(v, d, rng.choice([1, 5, 90 if d > 20 else 2]), "x") for v in (1, 2, None) for d in range(40) for _ in range(rng.randrange(3))]
    rows += [(4, 100, 7, "x"), (5, None, 3, "x"), (5, 3, None, "x"), (6, -2, -5, "x"), (6, -2, -5, "x"), (6, 9, 4, "x")]
    df = spark.createDataFrame(rows, "v long, d long, q int, `key` string").repartition(4)
    daily = defaultdict(Counter)
    for v, d, q, _ in rows:
        if d is not None and q is not None:
            daily[v][d] += q
    want = []
    for v, days in daily.items():
        first, last = min(days), max(days)
        values = [days[d] for d in range(first, last + 1)]
        best, found = changepoints.Series(values).segments()
        if len(values) <= 24:
            assert best == changepoints.brute_force(values)[0]
        assert sum(n for _, n, *_ in found) == len(values)
        want += [(v, i, first + a, n, t, s, c, len(found), best) for i, (a, n, t, s, c) in enumerate(found, 1)]
    got = changepoints.segments(df, key="v", day="d", value="q")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert changepoints.segments(df.limit(0), key="v", day="d", value="q").count() == 0


# ---------------------------------------------------------------- alignment


def brute_links(rows):
    """Links of every document by walking over bytes, and counts over all documents."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    made = []
    for _, text in rows:
        made.append(None)
        if not text:
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
        groups, at = [], [0, 0]
        for end in sorted(ends[0] & ends[1]):
            group = []
            for side, (ids, raw) in enumerate(((a, bytes_a), (b, bytes_b))):
                own = []
                while sum(map(len, raw[: at[side]])) < end:
                    own.append(ids[at[side]])
                    at[side] += 1
                group.append(own)
            groups.append(group)
        made[-1] = a, b, groups
    counts = Counter(pair for m in made if m for pair in {(x, y) for g, h in m[2] for x in g for y in h})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (k, _), m in zip(rows, made):
        if m is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g, h in m[2] for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in m[2])
        out.append((k, len(m[0]), len(m[1]), len(m[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "dense"), [(1, 1 << 10), (200, 1), (1 << 21, 1 << 10)])
def test_links_equal_brute_force(spark, monkeypatch, chunk, dense):
    monkeypatch.setattr(alignment, "DENSE", dense)
    rows, docs = documents(spark, 80)
    got = alignment.link_digests(docs, BPE, PIECES, chunk=chunk)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


def test_dense_groups_are_brought_together():
    t = alignment.aligner(BPE, PIECES)
    a, b = np.array([5, 6, 5, 7] * 30), np.array([9, 9, 8] * 30)
    ga, gb, doc = np.zeros(120, int), np.zeros(90, int), np.zeros(120, int)
    _, keys, links = t.pairs(a, b, ga, gb, doc)
    many = len(t.sizes[1])
    want = Counter(x * many + y for x in a.tolist() for y in b.tolist())
    assert dict(zip(keys.tolist(), links.tolist())) == want


def test_alignment_of_odd_rows(spark):
    rows = [(None, "one text"), (None, None), (7, "one text"), (7, "one text"), (8, "")]
    wide = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id int, text string, `chunk` string, `id` int").repartition(3)
    got = alignment.link_digests(wide, BPE, PIECES)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _keyed(rows)))
    assert alignment.link_digests(wide.limit(0), BPE, PIECES).count() == 0


def _keyed(rows):
    """brute_links() with null ids put back."""
    numbered = brute_links([(i, t) for i, (_, t) in enumerate(rows)])
    return [(rows[r[0]][0], *r[1:]) for r in numbered]


# ---------------------------------------------------------------- whole query against SQL


def test_change_points_equal_sql(spark):
    from latticegraph.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW sale_lines AS SELECT * FROM '/root/testdata/sf0.001/sale_lines.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_change_points"]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.op12_change_points(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
