"""Every operator and pipeline stage: clashing extra columns, nulls, empty texts, equal rows and empty tables."""

import random

import pytest

from latticegraph.llm import alignment, bpe, decontam, html, quality, sharding, simhash, substring, suffix, tokencount, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use inside, and names that need quoting.
CLASHES = "key __key spans __spans row __row fp id sha signature rank n_words part component_id fingerprint item_id a.b c`d KEY2 slot kept value".split()


def corpus(repeats):
    rng = random.Random(4)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}x" for _ in range(n))
    passage, item = words(70), words(20)
    rows = [(k, f"{words(60)} {passage if k % 3 == 0 else ''} {words(20)} {item if k % 5 == 1 else ''}") for k in range(10)]
    rows += [(20, rows[2][1]), (21, rows[2][1] + " tail"), (22, ""), (23, None)]
    if repeats:
        rows += [(None, rows[4][1]), (None, None), (3, "another text under one id " * 12), rows[5], rows[5]]
    return rows, item


def tables(spark, repeats):
    rows, item = corpus(repeats)
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    extra = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)
    wide = spark.createDataFrame([(*("z" for _ in CLASHES[:5]), *r, *("y" for _ in CLASHES[5:])) for r in rows], ", ".join([*extra.split(", ")[:5], "doc_id long, text string", *extra.split(", ")[5:]])).repartition(2)
    return plain, wide, spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")


READERS = {
    "substring": lambda d, b: substring.duplicate_passages(d),
    "suffix": lambda d, b: suffix.removal_digests(d),
    "decontam": lambda d, b: decontam.find_leaks(d, b),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "bpe": lambda d, b: bpe.encode_digests(d, BPE),
    "documents": lambda d, b: bpe.encode_documents(d, BPE),
    "sharding": lambda d, b: sharding.shuffle_into_shards(d).select("doc_id", "size", "text_crc32"),
    "tokens": lambda d, b: tokencount.token_counts(d, PIECES),
    "files": lambda d, b: tokenfile.file_digests(d.sparkSession, tokenfile.write_tokens(d, BPE)).drop("start"),
    "alignment": lambda d, b: alignment.link_digests(d, BPE, PIECES),
    "quality": lambda d, b: quality.judge(d).drop("rejected_by"),
}
FILTERS = {
    "filter": lambda d, b: quality.filter_documents(d),
    "near": lambda d, b: simhash.drop_near_duplicates(d),
    "repeats": lambda d, b: suffix.remove_repeats(d),
    "leaks": lambda d, b: decontam.drop_contaminated(d, b),
}


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("name", READERS)
def test_extra_columns_do_not_matter(spark, name, repeats):
    plain, wide, bench = tables(spark, repeats)
    got = rows_of(READERS[name](plain, bench))
    assert got and got == rows_of(READERS[name](wide, bench))
    empty = READERS[name](wide.limit(0), bench)
    assert empty.count() == 0 and empty.columns == READERS[name](plain, bench).columns


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(spark, name, repeats):
    plain, wide, bench = tables(spark, repeats)
    out = FILTERS[name](wide, bench)
    assert out.columns == wide.columns
    rows = out.collect()
    at = [wide.columns.index(c) for c in ("doc_id", "text")]
    assert all(v in "zy" for r in rows for k, v in enumerate(r) if k not in at)
    assert sorted(repr((r[at[0]], r[at[1]])) for r in rows) == rows_of(FILTERS[name](plain, bench))
    assert FILTERS[name](wide.limit(0), bench).count() == 0


def test_pages_with_other_columns_and_long_pages(spark):
    long = "<article>" + "<p>Some words of a long page, with commas.</p>" * 30_000 + "</article>"
    rows = [(1, "u", long, "z"), (1, "u", long, "z"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 40 * 30_000 - 1 + 0, 40 * 30_000 - 1 + 0]


def test_pipeline_over_odd_tables(spark, tmp_path):
    import corpus_pipeline

    for repeats in (False, True):
        plain, wide, bench = tables(spark, repeats)
        out = []
        for k, docs in enumerate((plain, wide, wide.limit(0))):
            folder = f"{tmp_path}/{repeats}{k}"
            docs.write.parquet(f"{folder}/documents.parquet")
            bench.write.parquet(f"{folder}/benchmark.parquet")
            out.append(rows_of(corpus_pipeline.run(spark, folder)))
        assert out[0] and out[0] == out[1] and not out[2]
