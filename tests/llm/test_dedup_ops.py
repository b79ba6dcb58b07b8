"""Quality rules, SimHash, suffix dedup, decontamination, BPE and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from latticegraph.llm import bpe, decontam, quality, sharding, simhash, suffix

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "thing", "ing", "ereon", "Ünd", "a", "erthon", "st", "re"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, periodic, empty, null and long texts."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = list(enumerate(base))
    rows += [(100 + k, base[k]) for k in range(8)] + [(200 + k, base[k].replace("thing", "wing", 1)) for k in range(8)]
    rows += [(300 + k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "aa" * 200), (404, "ab" * 150), (405, "aa" * 120), (406, "x"), (407, "one two"), (408, "One TWO")]
    rows += [(500, prose(rng, 20000)), (501, "é" * 130), (502, "xé" + "é" * 130)]
    return rows


# ---------------------------------------------------------------- suffix dedup


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        raw = (t or "").encode()
        cover = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                cover[p : p + length] = True
            seen.add(w)
        n_spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~cover])
        out.append((i, len(raw), int(cover.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("dense", [suffix.DENSE, 3])
def test_suffix_matches_brute_force(spark, corpus, dense):
    rows = [(i, t) for i, t in corpus if i != 400] + [(400, "")]
    got = sorted(map(tuple, suffix.removal_digests(table(spark, corpus), dense=dense).collect()))
    assert got == brute_repeats(rows)


def test_refinement_of_every_suffix_covers_what_is_removed(spark, corpus):
    from latticegraph.llm import pointers

    rows = [(k, t) for k, (_, t) in enumerate(corpus)] + [(9001, None), (9002, "x" * 240), (9003, "ab" * 60)]
    got = {(r.id, r.start) for r in pointers.repeated_starts(table(spark, rows)).collect()}
    seen, want = set(), set()
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                want.add((i, p))
            seen.add(raw[p : p + 100])
    assert got == want and got
    removed = {r.doc_id: r.n_removed for r in suffix.removal_digests(table(spark, rows)).collect()}
    for i, _ in rows:
        assert removed[i] == len({b for k, p in got if k == i for b in range(p, p + 100)})
    assert pointers.repeated_starts(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        pointers.repeated_starts(table(spark, [(1, "a"), (1, "b")]))


def test_suffix_long_text_spans_chunks(spark):
    rng = random.Random(5)
    text = prose(rng, 60000)
    rows = [(1, text), (2, text[150_000:151_000] + "tail")]
    got = sorted(map(tuple, suffix.removal_digests(table(spark, rows)).collect()))
    assert got == brute_repeats(rows)


def test_suffix_ties_nulls_and_empty(spark):
    same = "abcdefghij" * 30
    rows = [(7, same), (7, same), (7, same + "z"), (None, same), (8, None)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in suffix.removal_digests(table(spark, rows)).collect()}
    assert len(got) == 4 and got[(7, 301)][0] > 0 and got[(8, 0)] == (0, 0)
    assert suffix.removal_digests(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("dense", [suffix.DENSE, 1])
def test_suffix_repeated_rows_share_one_verdict(spark, dense):
    rng = random.Random(8)
    passage, word = prose(rng, 50), lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    distinct = [(1, f"{word(20)} {passage} {word(20)}"), (2, f"{word(9)} {passage} {word(30)}"), (3, f"{passage[:150]} {word(30)}")]
    for twice in range(3):
        rows = distinct + [distinct[twice]]
        got = sorted(map(tuple, suffix.removal_digests(table(spark, rows), dense=dense).collect()))
        assert got == sorted(brute_repeats(distinct) + [brute_repeats(distinct)[twice]])


def test_remove_repeats_changes_the_text(spark, corpus):
    rows = [(i, t) for i, t in corpus if t is not None]
    want = {i: (n, m) for i, n, m, _, _ in brute_repeats(rows)}
    for r in suffix.remove_repeats(table(spark, rows)).collect():
        n, m = want[r[0]]
        assert abs(len(r[1].encode()) - (n - m)) <= 4 * 80 and (m or r[1] == dict(rows)[r[0]])


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return comp


@pytest.mark.parametrize("dense", [simhash.DENSE, 1])
def test_simhash_matches_brute_force(spark, corpus, dense):
    fps = {i: brute_fingerprint(t) for i, t in corpus}
    comp = brute_components(fps)
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(table(spark, corpus), dense=dense).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


@pytest.mark.parametrize("dense", [simhash.DENSE, 4])
def test_simhash_links_of_random_balls(spark, dense):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    vals = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            vals.add(x)
    vals = sorted(vals)
    comp = brute_components(dict(enumerate(vals)))
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), dense).collect()
    index = {v: k for k, v in enumerate(signed)}
    parent = list(range(len(vals)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = sorted((root(index[a]), root(index[b])))
        assert bin(vals[index[a]] ^ vals[index[b]]).count("1") <= 3
        parent[y] = x
    assert {k: root(k) for k in range(len(vals))} == comp


def test_simhash_ties_nulls_and_empty(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q"), (9, None), (10, "")]
    got = sorted(((r[0], r[2]) for r in simhash.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (None, None), (9, 9), (10, 9)], key=str)
    kept = simhash.drop_near_duplicates(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "source"] and 10 not in {r[0] for r in kept.collect()}
    assert simhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_dropping_stages_act_on_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "own text of five"), (None, "x y z q"), (None, "x y z q")]
    kept = [(r[0], r[1]) for r in simhash.drop_near_duplicates(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(3, "a b c d"), (5, "own text of five"), (None, "x y z q")], key=str)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, "clean"), (None, f"so {item}"), (None, "clean too"), (2, "clean")]
    out = decontam.drop_contaminated(table(spark, rows), bench)
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == sorted([(1, "clean"), (None, "clean too"), (2, "clean")], key=str)


# ---------------------------------------------------------------- quality rules


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_verdict(spark, corpus):
    rows = [r for r in corpus if r[0] != 500] + [(600, "a b c d " * 30), (601, "x # y *\n" * 80), (602, "é\x0bü\x85 z q " * 20)]
    got = {r["doc_id"]: r for r in quality.judge(table(spark, rows)).collect()}
    for i, t in rows:
        r, want = got[i], brute_counts(t)
        assert tuple(r[1:6]) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (r.rejected_by is None) and (not r.kept or not r.base_failed)
    kept = {r[0] for r in quality.filter_documents(table(spark, rows)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert quality.judge(table(spark, rows).limit(0)).count() == 0


def test_the_order_changes_the_work_and_not_the_verdict():
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(30)] + ["12 34 " * 40] * 5 + ["- a b c\n" * 60] * 5 + ["word " * 3]
    work, verdicts = [], []
    for rules in (quality.RULES, quality.RULES[::-1]):
        asked = []
        counting = [quality.Rule(r.name, lambda f, r=r: (asked.append(r.name), r.rejects(f))[1], r.base) for r in rules]
        verdicts.append([quality.first_rejection(quality.Features(t), tuple(counting)) is None for t in texts])
        work.append(len(asked))
    assert verdicts[0] == verdicts[1] and work[0] != work[1]
    f = quality.Features(texts[-1])
    assert quality.first_rejection(f, quality.RULES) == "few_words" and "n_wordless" not in f.__dict__ and "lines" not in f.__dict__


def test_the_sample_comes_from_every_partition(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("cast(id as string) as text")
    drawn = rows.mapInArrow(quality._heads(2**63 - 1), "rank long, text string").collect()
    assert {int(r.text) // 500 for r in drawn} == set(range(8)) and len(drawn) == 8 * quality.PER_PARTITION
    assert sorted(r.rank for r in drawn) == sorted(r.rank for r in rows.mapInArrow(quality._heads(), "rank long").collect())
    assert len(quality.plan_cascade(rows, sample_rows=10)) == len(quality.RULES)


def test_quality_order_is_by_rejections_per_cost():
    slow = quality.Rule("slow", lambda f: sum(range(20000)) < 0)
    hits = quality.Rule("hits", lambda f: True)
    assert [r.name for r in quality.estimate_order(["a"] * 20, (slow, hits))] == ["hits", "slow"]


# ---------------------------------------------------------------- decontamination


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(13, 40)))) for k in range(30)] + [(90, None), (91, "tiny item"), (92, "")]
    rows, want = [], set()
    for k in range(30):
        w = items[k][1].split()
        for j in rng.sample(range(len(w)), len(w) // 6):
            w[j] = "changed"
        rows.append((k, " ".join(rng.choices(vocabulary, k=50) + w + rng.choices(vocabulary, k=50)).title()))
        want.add((k, k))
    rows += [(100 + k, " ".join(rng.choices(vocabulary, k=200))) for k in range(20)] + [(200, None), (201, ""), (202, "so a Tiny ITEM here")]
    want.add((202, 91))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_equal >= 0.8 * r.n_overlap for r in got)
    kept = {r[0] for r in decontam.drop_contaminated(table(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.find_leaks(table(spark, rows), bench.limit(0)).count() == 0
    # several blocks, item ids of another type and of the name of the document's
    named = bench.selectExpr("concat('i', item_id) as doc_id", "text")
    old, decontam.BLOCK_ITEMS = decontam.BLOCK_ITEMS, 7
    try:
        many = decontam.find_leaks(table(spark, rows + rows[:2]), named, item_col="doc_id").collect()
    finally:
        decontam.BLOCK_ITEMS = old
    assert sorted((r.doc_id, r.item_doc_id) for r in many) == sorted([(a, f"i{b}") for a, b in ((r.doc_id, r.item_id) for r in got)] + [(0, "i0"), (1, "i1")])
    assert decontam.find_leaks(table(spark, rows).limit(0), bench).count() == 0


def test_decontamination_finds_parts_and_shifted_copies(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, words(n)) for k, n in enumerate([45, 45, 15, 15, 40, 45, 59])]
    parts = [
        items[0][1][8:38],  # 30 of 45 words
        items[1][1][:22] + ["new"] + items[1][1][22:],
        items[2][1][:7] + ["new"] + items[2][1][7:],
        items[3][1][:7] + items[3][1][8:],
        items[4][1][20:33],  # 13 words
        items[5][1][:10],  # one too few of 13
        items[6][1][:9] + words(9) + items[6][1][9:18],  # two pieces too far from each other
    ]
    rows = [(k, " ".join(words(60) + part + words(60))) for k, part in enumerate(parts)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = decontam.find_leaks(table(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(5)]
    assert all(0 < r.start_word < r.end_word < len(rows[r.doc_id][1].split()) and 0.8 * r.n_overlap <= r.n_equal for r in got)
    assert {r[0] for r in decontam.drop_contaminated(table(spark, rows), bench).collect()} == {5, 6}


def test_best_window_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(13, 26))
        item, doc = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 40, 60).astype(np.uint64)
        doc[20 : 20 + n] = item
        doc[20 + rng.integers(0, n, int(rng.integers(2, 9)))] = 99
        got = decontam.best_window(doc, item, np.array([20]), 0.8, 13)
        same = doc[20 : 20 + n] == item
        want = max((q - p for p in range(n) for q in range(p + 13, n + 1) if same[p:q].sum() >= 0.8 * (q - p) - 1e-9), default=None)
        assert (got and got[2] - got[1]) == want


def test_masks_leave_few_gaps():
    """Overlaps of 13 words at 0.8: the share of substitution patterns that no mask hits."""
    rng, missed = random.Random(2), 0
    for _ in range(4000):
        n = rng.randint(13, 45)
        bad = set(rng.sample(range(n), n // 5))
        ok = [k not in bad for k in range(n)]
        missed += not any(all(ok[p + k] for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(n - len(m) + 1))
    assert missed <= 20


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE_PATH)


SMALL = bpe.TreeBpe(BPE_PATH, leaf=8, leaf_bytes=4, window=16, threads=1)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "\t", "a", "é", "漢字", "🙂", "'ll", "'s", "1234", "!!", "<|endoftext|>", " ", "\x1c", " ", "zq", "aaaa"]), max_size=40).map("".join))
def test_bpe_equals_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert SMALL.encode(text) == want
    assert SMALL.decode(want) == library.decode(want, skip_special_tokens=False)


def test_texts_of_the_table_go_through_joins(library):
    import pyarrow.parquet as pq

    tree = bpe.TreeBpe(BPE_PATH)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t and len(t) > bpe.LEAF]
    for t in texts:
        assert tree.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert tree.joins >= len(texts) > 0 and tree.windows > 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.TreeBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_documents(spark, corpus, library):
    rows = corpus + [(700, "a" * 30000), (701, " " * 20000 + "x"), (702, "".join(random.Random(4).choices("abcdefgh0123=+/", k=40000))), (703, "<|endoftext|>")]
    got = {r[0]: r for r in bpe.encode_digests(table(spark, rows), BPE_PATH).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    tree = bpe.TreeBpe(BPE_PATH)
    assert tree.threads > 1
    for _, t in rows:
        tree.encode(t)
    assert tree.joins > 20 and tree.windows > 10 and tree.token_joins > 5
    assert bpe.encode_digests(table(spark, rows).limit(0), BPE_PATH).count() == 0
    twice = bpe.encode_digests(table(spark, [rows[0], rows[0]]), BPE_PATH).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    one = bpe.encode_documents(table(spark, rows[:5]), BPE_PATH).collect()
    assert all(r.decoded == dict(rows)[r[0]] for r in one)


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("options", [{}, {"block_rows": 5, "bin_rows": 1}])
def test_sharding_is_exact(spark, corpus, options):
    rows = corpus + [(None, "x"), (None, "x"), (1, "y"), (1, "y")]
    got = sharding.shuffle_into_shards(table(spark, rows), **options).collect()
    assert sorted(str((r[0], r[1], r[2])) for r in got) == sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in rows)
    sizes = [sum(r.shard == k for r in got) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(24):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    assert sharding.shuffle_into_shards(table(spark, rows).limit(0)).count() == 0


def test_matrix_and_large_draws():
    m = sharding.communication_matrix([10, 0, 7, 100], 24, 1)
    assert [sum(r) for r in m] == [10, 0, 7, 100]
    assert sorted(sum(c) for c in zip(*m)) == sorted([117 // 24 + (k < 117 % 24) for k in range(24)])
    big = sharding.communication_matrix([3 * 10**9, 10**9], 3, 1)
    assert [sum(r) for r in big] == [3 * 10**9, 10**9] and abs(big[0][0] - 10**9) < 10**6
    for good, bad, draws, x in ((30, 70, 20, 6), (5000, 90_000, 3000, 150), (5, 3, 4, 2), (3, 9, 5, 0)):
        exact = math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws)
        assert abs(math.exp(sharding.log_probability(x, good, bad, draws)) / exact - 1) < 1e-12
    mean = (1 << 20) * 4 // 100
    assert abs(sum(math.exp(sharding.log_probability(x, 4 * 10**9, 96 * 10**9, 1 << 20)) for x in range(mean - 3000, mean + 3000)) - 1) < 1e-11
    rng = random.Random(0)
    draws = [sharding.hypergeometric(30, 70, 20, rng) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
