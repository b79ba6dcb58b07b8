"""A corpus pipeline of five stages: quality rules, SimHash near-dedup, suffix-array dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns doc_id, n_tokens, ids and decoded_sha256.

Defined results: a null text counts as empty, and quality rules reject it; rows with a null or repeated id are judged one
by one; of equal rows one stays; an empty table gives an empty result; other columns, whatever their names, stay up to
the last stage. Tables that a stage writes for its own use are deleted when the next has read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticegraph.llm import bpe, decontam, quality, simhash, suffix
from latticegraph.llm.common import materialize, release, scratch
from latticegraph.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.filter_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat an earlier string of 100 bytes."""
    return suffix.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts, and a digest of what they decode to."""
    out = bpe.encode_documents(docs, tokenizer_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as keep:
        for name, stage in STAGES[:-1]:
            with scratch() as hold:
                done = hold(materialize(stage(spark, docs, sf_dir), name))
            release(docs)
            docs = done
        return STAGES[-1][1](spark, keep(docs), sf_dir)


#: SQL cannot express the fingerprints, the seeds or the encoding; the run is tested against brute force.
ORACLE_SQL = None
