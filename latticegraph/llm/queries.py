"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, changepoints, decontam, html, quality, sharding, simhash, substring, suffix, tokencount, tokenfile, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passage_classes(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(warc.records_of_pages(_read(spark, sf_dir, "pages")))
    return done.select(F.col("id").alias("page_id"), "canonical_url", "type", "outcome", "source_id", F.char_length("payload").cast("long").alias("n_chars"), F.md5(F.encode("payload", "UTF-8")).alias("payload_md5"), F.element_at("headers", "date").alias("date_header"), F.element_at("headers", "content-type").alias("content_type"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("rejected_by")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.file_digests(spark, tokenfile.write_tokens(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "sale_lines").filter(F.col("flag").isin("kept", "swapped") & F.col("quantity").isNotNull() & F.col("shipped_at").isNotNull())
    return changepoints.segments(lines.select("vendor_id", F.unix_date(F.col("shipped_at").cast("date")).cast("long").alias("day"), "quantity"), key="vendor_id", day="day", value="quantity")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digests(_read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_files": op11_token_files,
    "op12_change_points": op12_change_points,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL = {
    "op12_change_points": r"""
WITH RECURSIVE d AS (
  SELECT vendor_id, (shipped_at::DATE - DATE '1970-01-01')::BIGINT AS day, sum(quantity)::BIGINT AS q
  FROM sale_lines WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
v AS (SELECT vendor_id, min(day) AS first, max(day) - min(day) + 1 AS n FROM d GROUP BY vendor_id),
f AS (SELECT v.vendor_id, first, n, i, coalesce(q, 0) AS q
      FROM (SELECT *, unnest(range(n)) AS i FROM v) v LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM v.vendor_id AND d.day = first + i),
c AS (SELECT vendor_id, first, n, i + 1 AS e, sum(q) OVER w::HUGEINT AS s, sum(q::HUGEINT * q) OVER w::HUGEINT AS r
      FROM f WINDOW w AS (PARTITION BY vendor_id, first ORDER BY i)),
p AS (SELECT vendor_id, first, n, [0::HUGEINT] || list(s ORDER BY e) AS s, [0::HUGEINT] || list(r ORDER BY e) AS r FROM c GROUP BY ALL),
-- g: for each end its least cost, number of segments and start of the last segment, one end more at each step
g AS (
  SELECT vendor_id, first, n, s, r, 0 AS e, [{'c': 0::BIGINT, 'k': 0::BIGINT, 'a': 0::BIGINT}] AS best FROM p
  UNION ALL
  SELECT vendor_id, first, n, s, r, e + 1, best || [list_min(list_transform(
      list_filter(range(e + 1), lambda a: a = 0 OR (a >= 5 AND e + 1 - a >= 5)),
      lambda a: {'c': best[a + 1].c + CASE WHEN a = 0 THEN 0 ELSE 10000 END + (e + 1 - a) * floor(1000 * ln((1 +
          ((e + 1 - a) * (r[e + 2] - r[a + 1]) - (s[e + 2] - s[a + 1]) * (s[e + 2] - s[a + 1])) // ((e + 1 - a) * (e + 1 - a)))::DOUBLE))::BIGINT,
        'k': best[a + 1].k + 1, 'a': a}))]
  FROM g WHERE e < n),
t AS (
  SELECT vendor_id, first, n, s, r, best, n AS e, best[n + 1].a AS a FROM g WHERE e = n
  UNION ALL
  SELECT vendor_id, first, n, s, r, best, a, best[a + 1].a FROM t WHERE a > 0),
x AS (SELECT *, e - a AS days, s[e + 1] - s[a + 1] AS total,
             1 + ((e - a) * (r[e + 1] - r[a + 1]) - (s[e + 1] - s[a + 1]) * (s[e + 1] - s[a + 1])) // ((e - a) * (e - a)) AS spread FROM t)
SELECT vendor_id, row_number() OVER (PARTITION BY vendor_id, first ORDER BY a) AS segment_no, (first + a)::BIGINT AS first_day, days::BIGINT AS n_days,
       total::BIGINT AS total, spread::BIGINT AS spread, days::BIGINT * floor(1000 * ln(spread::DOUBLE))::BIGINT AS cost,
       best[n + 1].k AS n_segments, best[n + 1].c AS best_cost
FROM x""",
    "op8_warc_revisits": r"""
WITH a AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
         coalesce(regexp_matches(url, '#|[?&]utm_'), false) AS revisit, md5(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) AS tag
  FROM pages),
b AS (
  SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS front,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|sessionid)='))) AS kept
  FROM a),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(front, '^([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(front, '^[^/]*(.*)$', 1), '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM b),
s AS (
  SELECT *, max(CASE WHEN NOT revisit THEN page_id END) OVER (PARTITION BY canonical_url ORDER BY page_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src
  FROM c),
r AS (
  SELECT s.*, f.page_id AS full_id, f.html AS full_html,
         CASE WHEN NOT s.revisit THEN 'full' WHEN f.page_id IS NULL THEN 'missing' WHEN left(s.tag, 16) <> left(f.tag, 16) THEN 'changed'
              WHEN s.tag IS NULL OR f.tag IS NULL THEN 'unchecked' ELSE 'resolved' END AS outcome
  FROM s LEFT JOIN c f ON s.revisit AND f.page_id = s.src AND s.canonical_url IS NOT NULL)
SELECT page_id, canonical_url, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS type, outcome,
       CASE WHEN outcome = 'resolved' THEN full_id END AS source_id,
       length(CASE outcome WHEN 'resolved' THEN full_html WHEN 'full' THEN html END)::BIGINT AS n_chars,
       md5(CASE outcome WHEN 'resolved' THEN full_html WHEN 'full' THEN html END) AS payload_md5,
       't' || page_id AS date_header,
       CASE WHEN outcome IN ('full', 'resolved') THEN 'text/html' END AS content_type
FROM r""",
    "op9_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - list_unique(ls))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda x: regexp_full_match(x, '[\x00-\x7F]+') AND NOT regexp_matches(x, '[A-Za-z]'))) AS n_wordless,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•*‣▪-]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut
  FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 2 * n_dup_lines <= n_lines
       AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 2 * n_wordless <= n_words
       AND 10 * n_bullets <= 9 * n_lines AND 10 * n_cut <= 3 * n_lines AS kept
FROM b""",
}
