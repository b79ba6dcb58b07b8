"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints are 64 bits over three-word shingles. Two of them link at three or fewer differing bits. With eight
segments of eight bits in a ring, some start satisfies every chain budget: the first l segments differ in at most
3 * l / 8 bits, so two segments agree and of the next three at most one differs. Every fingerprint is filed under 8
starts times 3 choices of the segment that may differ, each a key of 32 exact bits; candidates that share a key must
also meet the budgets of the longer chains before the full Hamming check.

Equal fingerprints are one row before any candidate is made. Keys with more than DENSE fingerprints are not compared
pairwise: each fingerprint is filed under its variants with one bit flipped (as a centre) and with up to two (as a
leaf); all that meet at a variant with a centre are linked through it, which is exact, because two centres differ in
at most two bits and a centre and a leaf in at most three.

Defined results: a null text counts as empty and has fingerprint zero, which links like any other; rows that repeat an
id are each reported; a null id is never the component id unless all ids of its component are null; an empty table
gives an empty result; other columns, whatever their names, are ignored by fingerprints() and kept by
drop_near_duplicates(), which tells rows with a null or repeated id apart.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, column, ddl_name, has_repeated_ids, materialize, numbered_rows, rows_with, scratch, small_side, thrifty
from .components import connected_components

MAX_BITS = 3
SEED = 42
WORDS = 3
#: Fingerprints under one key above which variants replace pairwise comparison.
DENSE = 8192

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return digest(joined, SEED)  # one shingle: its own bits are the majority
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - WORDS + 1
    h = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist())], U64, n)
    by = h.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(by[:, k], minlength=256) @ _BITS for k in range(7, -1, -1)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), U64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(column(id_col), column(text_col)).mapInArrow(thrifty(run), f"{ddl_name(id_col)} {id_type}, fp long")


# ---------------------------------------------------------------- candidates

_VARIANTS = [(i, miss) for i in range(8) for miss in range(3)]


def _exact_segments(i: int, miss: int) -> list[int]:
    """Ring places of the four segments, from the top, that must agree for this start and choice."""
    return [i, (i + 1) % 8, *((i + 2 + k) % 8 for k in range(3) if k != miss)]


def _keyed(fps: DataFrame) -> DataFrame:
    """tab (0 to 23), key (32 bits) and fp, 24 rows per fingerprint."""
    seg = lambda s: F.shiftrightunsigned("fp", 56 - 8 * s).bitwiseAND(F.lit(255))
    rows = []
    for tab, (i, miss) in enumerate(_VARIANTS):
        key = F.lit(0).cast("long")
        for s in _exact_segments(i, miss):
            key = F.shiftleft(key, 8).bitwiseOR(seg(s))
        rows.append(F.struct(F.shiftleft(F.lit(tab).cast("long"), 32).bitwiseOR(key).alias("key")))
    return fps.select("fp", F.inline(F.array(*rows)).alias("key"))


def _chain_ok(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether xors x meet the budgets of all chains from segment start, the last being the full Hamming check."""
    r = (U64(8) * start.astype(U64)) & U64(63)
    turned = np.where(r == 0, x, (x << r) | (x >> ((U64(64) - r) & U64(63))))
    ok = np.ones(len(x), bool)
    for chain in range(1, 9):
        ok &= np.bitwise_count(turned >> U64(64 - 8 * chain)) <= MAX_BITS * chain // 8
    return ok


def _forest(fps: np.ndarray, tab: int) -> list[tuple[int, int]]:
    """Edges that connect, within one key, all fingerprints joined by links that satisfy the chains."""
    n, parent = len(fps), list(range(len(fps)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    start = np.full(n, _VARIANTS[tab][0])
    out = []
    for k in range(n - 1):
        for m in np.flatnonzero(_chain_ok(fps[k + 1 :] ^ fps[k], start[k + 1 :])) + k + 1:
            a, b = root(k), root(int(m))
            if a != b:
                parent[b] = a
                out.append((k, int(m)))
    return out


def _links_of_sorted(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all whole groups of equal keys."""
    bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    ok = _chain_ok(fps[two] ^ fps[two + 1], np.array([v[0] for v in _VARIANTS])[keys[two] >> 32])
    a, b = [fps[two[ok]]], [fps[two[ok] + 1]]
    for k in np.flatnonzero(sizes > 2):
        own = fps[bounds[k] : bounds[k + 1]]
        if pairs := _forest(own, int(keys[bounds[k]] >> 32)):
            a.append(own[[p[0] for p in pairs]])
            b.append(own[[p[1] for p in pairs]])
    return np.concatenate(a), np.concatenate(b)


def _near_links(batches):
    """Links among rows sorted by key; only whole groups are compared, the last waits for the next batch."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, U64)

    def out(k, f):
        a, b = _links_of_sorted(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(U64)])
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(keys, fps)


def _variant_masks(tab: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of at most one and at most two flipped bits among those the key leaves open."""
    closed = set(_exact_segments(*_VARIANTS[tab]))
    bits = [1 << (63 - 8 * s - k) for s in range(8) if s not in closed for k in range(8)]
    one = [0, *bits]
    return np.array(one, U64), np.array([*one, *(x | y for x, y in itertools.combinations(bits, 2))], U64)


def _variants(batches):
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
        for tab in np.unique(keys >> 32):
            own = np.flatnonzero(keys >> 32 == tab)
            one, two = _variant_masks(int(tab))
            for at in range(0, len(own), 512):
                part = own[at : at + 512]
                node = (fps[part][:, None] ^ two[None, :]).ravel().view(np.int64)
                centre = np.tile(np.arange(len(two)) < len(one), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[part], len(two))), pa.array(node), pa.array(np.repeat(fps[part], len(two)).view(np.int64)), pa.array(centre)], ["key", "node", "fp", "centre"])


def near_links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that have the components of all links."""
    keyed = _keyed(fps)
    hot = materialize(keyed.groupBy("key").count().filter(F.col("count") > dense).select("key"), "dense-keys")
    if hot.isEmpty():
        cold, links = keyed, None
    else:
        few = small_side(hot)
        cold = keyed.join(few, "key", "left_anti")
        filed = keyed.join(few, "key", "left_semi").select("key", "fp").mapInArrow(thrifty(_variants), "key long, node long, fp long, centre boolean")
        centres = filed.filter("centre").groupBy("key", "node").agg(F.min("fp").alias("b"))
        links = filed.join(centres, ["key", "node"]).select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cold.select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(thrifty(_near_links), "a long, b long").distinct()
    return found if links is None else found.union(links)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row."""
    with scratch() as keep:
        own = keep(materialize(fingerprints(docs, id_col=id_col, text_col=text_col).toDF("id", "fp"), "fingerprints"))
        classes = materialize(own.groupBy("fp").agg(F.min("id").alias("low")), "fingerprint-classes")
        parts = connected_components(near_links(classes.select("fp"), dense))
        named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
        lows = named.groupBy("part").agg(F.min("low").alias("component_id"))
        of_fp = keep(materialize(named.join(lows, "part").select("fp", "component_id"), "components"))
    return own.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row of docs for each group, with all columns: that of the smallest id, nulls last.

    Of rows that share that id one is kept.
    """
    with scratch() as keep:
        if not has_repeated_ids(docs, id_col):
            found = near_duplicates(docs, id_col=id_col, text_col=text_col, dense=dense).toDF("id", "fingerprint", "component_id")
            dropped = keep(materialize(found.filter("id <> component_id").select("id").distinct(), "near-duplicates"))
            return rows_with(docs, id_col, small_side(dropped), "left_anti")
        rows, row = numbered_rows(docs)
        keep(rows)
        found = near_duplicates(rows, id_col=row, text_col=text_col, dense=dense).toDF("row", "fingerprint", "component_id")
        rank = rows.select(F.col(row).alias("row"), F.struct(column(id_col).isNull().alias("no_id"), column(id_col).alias("id"), F.col(row).alias("row")).alias("rank"))
        least = found.join(rank, "row").groupBy("component_id").agg(F.min("rank").alias("least"))
        kept = keep(materialize(least.select("least.row"), "kept-rows"))
        return rows_with(rows, row, small_side(kept), "left_semi").drop(row)
