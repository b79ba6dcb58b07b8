"""Uniform shuffle into shards of exact size, with a hypergeometric communication matrix.

Rows are numbered within blocks (a source partition, or a stretch of BLOCK_ROWS rows of a large one). The counts of
every block are known, and the number of its rows that go to each shard is drawn exactly: block after block from a
multivariate hypergeometric law over what the shards still have to fill. Rows are permuted locally within their block,
the first so many go to shard 0, the next to shard 1 and so on, and within a shard they are permuted again. Every
assignment with shard sizes at most one apart is equally likely.

The second permutation sorts a shard by a random key. It is done in bins of the key range, whose offsets come from
their counts, so no task sorts a whole shard and the slots still have no gap.

The law is `rows`: shard sizes differ by one at most. Everything that touches rows is a DataFrame expression; only
block counts (one number per block) reach the driver, where the matrix is drawn and written a part at a time. Up to 10^9
rows that are left the draw is the library's exact one, beyond it is by inversion of probabilities that are right to
about twelve digits whatever the counts.

Defined results: a null text has no bytes (size 8, checksum 0); rows with equal or null ids are placed apart, each
once; an empty table gives an empty result; other columns, whatever their names, are ignored. The same seed and file layout give the same
placement.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, materialize

SHARDS = 24
SEED = 20
BLOCK_ROWS = 1 << 20
BIN_ROWS = 1 << 18
#: Blocks whose part of the matrix is in a plan at once.
MATRIX_BLOCKS = 4096


def _log_factorial_rest(n: int) -> float:
    """log(n!) less its Stirling approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = float(n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x**2) / x**2) / x**2) / x


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        out, term = (x - mean) * v, 2 * x * v
        k = 1
        while True:
            term *= v * v
            more = out + term / (2 * k + 1)
            if more == out:
                return out
            out, k = more, k + 1
    return x * math.log(x / mean) + mean - x if x else mean


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log-probability of x of n by the saddle point, accurate for any n (C. Loader, 2000)."""
    if x == 0:
        return n * math.log1p(-p) if p < 0.5 else n * math.log(q)
    if x == n:
        return n * math.log(p) if p < 0.5 else n * math.log1p(-q)
    rest = _log_factorial_rest(n) - _log_factorial_rest(x) - _log_factorial_rest(n - x)
    return rest - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_probability(x: int, good: int, bad: int, draws: int) -> float:
    """Log-probability of x good ones among draws; its relative error stays near that of a double for any counts."""
    total = good + bad
    if draws in (0, total):
        return 0.0
    p, q = draws / total, (total - draws) / total
    return _log_binomial(x, good, p, q) + _log_binomial(draws - x, bad, p, q) - _log_binomial(draws, total, p, q)


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Good ones among draws without replacement: inversion outward from the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    p = math.exp(log_probability(mode, good, bad, draws))
    u = rng.random() - p
    left, right, pl, pr = mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def matrix_rows(block_rows: list[int], shards: int, seed: int):
    """Rows that each block sends to each shard, a block at a time; column sums are the exact shard sizes."""
    total = sum(block_rows)
    left = [total // shards + (k < total % shards) for k in range(shards)]
    fast, slow = np.random.Generator(np.random.PCG64(seed)), random.Random(seed)
    rest = total
    for n in block_rows:
        if rest < 10**9:  # the bound of the library's exact draw
            row = fast.multivariate_hypergeometric(left, n, method="marginals").tolist()
        else:
            row, todo, behind = [], n, rest
            for k in range(shards - 1):
                behind -= left[k]
                row.append(hypergeometric(left[k], behind, todo, slow))
                todo -= row[-1]
            row.append(todo)
        left = [a - b for a, b in zip(left, row)]
        rest -= n
        yield row


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """All rows of the matrix."""
    return list(matrix_rows(block_rows, shards, seed))


def _matrix_table(spark: SparkSession, counts: list[tuple[int, int]], shards: int, seed: int) -> DataFrame:
    """block and cut (running sums of its row of the matrix), written MATRIX_BLOCKS blocks at a time.

    The driver holds one number per block and the rows of one part; the table is read like any other.
    """
    drawn = matrix_rows([n for _, n in counts], shards, seed)
    parts = []
    for lo in range(0, max(len(counts), 1), MATRIX_BLOCKS):
        cuts = [[block, *itertools.accumulate(next(drawn))] for block, _ in counts[lo : lo + MATRIX_BLOCKS]]
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(cuts)), "array<array<bigint>>")).alias("cut"))
        parts.append(materialize(rows.select(F.col("cut")[0].alias("block"), F.slice("cut", 2, shards).alias("cut")), "matrix"))
        if len(parts) == 16:
            parts = [materialize(reduce(DataFrame.union, parts), "matrix")]
    return reduce(DataFrame.union, parts)


def shuffle_into_shards(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    raw = F.encode(F.coalesce(column(text_col), F.lit("")), "UTF-8")
    rows = docs.select(column(id_col).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(rows, "shard-rows")  # numbered once, so a task that runs again sees the same numbers
    part, place = F.shiftright("rid", 33), F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))
    per = max(1, block_rows)
    rows = rows.withColumn("block", part * F.lit((1 << 33) // per + 1) + F.floor(place / per))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("block").count().collect())
    table = _matrix_table(docs.sparkSession, counts, shards, seed)
    # the local permutation, then the first so many rows to each shard
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("rid", F.lit(seed)), "rid"))
    sent = rows.withColumn("rank", rank).join(table, "block")
    sent = sent.select("id", "size", "crc", "rid", F.size(F.filter("cut", lambda c: c < F.col("rank"))).alias("shard"))
    # the second permutation, in bins of the key range
    total = sum(n for _, n in counts)
    bins = max(1, -(-total // (shards * bin_rows)))
    key = F.xxhash64("rid", F.lit(seed + 1))
    sent = sent.withColumn("key", key).withColumn("bin", F.floor((F.shiftright("key", 16) + F.lit(1 << 47)) * F.lit(bins) / F.lit(1 << 48)))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offset = sent.groupBy("shard", "bin").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("key", "rid"))
    done = sent.withColumn("place", place).join(offset.drop("count"), ["shard", "bin"])
    return done.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
