"""Removal of repeated 100-byte strings by bucket-pointer refinement.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a smaller document id, or at an earlier
place of the same document) is removed; matches never cross documents, overlaps count, and strings are judged on the
input. The suffix order is refined bucket by bucket, on the starts that still matter:

1. Initial buckets are q-grams of GRAM bytes. Each window of LENGTH bytes is represented by its smallest gram (the
   leftmost of equal ones), which its content alone decides, so equal windows stand in equal buckets at the same
   offset. A run of windows with one gram occurrence is one entry. Entries alone in their bucket repeat nothing and go.
2. Entries of a bucket are refined by the bucket identifier of the whole span their windows cover. Entries with equal
   spans repeat each other at every offset: all but the earliest are wholly repeated.
3. The earliest of each span is compared with the other spans of its gram bucket. Buckets of at most DENSE spans are
   finished in one task. Larger ones are refined recursively: the offsets are halved, entries are filed under the
   identifier of the bytes that all windows of their half share, and the identifiers found there are refined again;
   at single offsets the bucket is the window itself, and its earliest start is a map-side combined minimum.

Bucket identifiers of step 2 are two hashes modulo primes near 2^31, with random tables and bases of their own, within one
gram bucket; windows of step 3 are compared as bytes. Entries are computed in one pass over the texts and written.

Defined results: a null text counts as empty; a text shorter than LENGTH loses nothing; rows with a null or repeated id
are told apart by their text and ordered by (id, hash of the text), nulls first, and equal rows share one verdict;
an empty table gives an empty result; other columns, whatever their names, are ignored by repeated_spans() and kept by
remove_repeats().
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLE, U64, column, ddl_name, doc_chunks, drop_finished, free_names, has_repeated_ids, map_rows, materialize, mix, ranges, release, scratch, sliding_min, small_side, thrifty, utf8_views

LENGTH = 100
GRAM = 32
#: Spans of one gram bucket above which refinement goes on in shuffles instead of one task.
DENSE = 4096
#: Parts that the buckets are gone through in.
SLICES = 4
#: Spans, each of a few numbers, that are sent to every executor at most (about 100 MB); more are joined by a shuffle.
SPAN_CELLS = 2_000_000

_CHUNK = 1 << 17
#: Primes and bases of the two hashes of a span; their tables of bytes are random and independent.
_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = (1_103_515_245, 1_664_525)
_TABLES = np.random.Generator(np.random.PCG64(43)).integers(1, _PRIMES[1], (2, 256), dtype=np.int64)


@lru_cache(2)
def _prime_powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, for every place of a chunk."""
    out, prime = [], _PRIMES[k]
    for base in (_BASES[k], pow(_BASES[k], -1, prime)):
        powers = np.ones(2 * _CHUNK, np.int64)
        n = 1
        while n < len(powers):
            powers[n : 2 * n] = powers[:n] * pow(base, n, prime) % prime
            n *= 2
        out.append(powers)
    return out[0], out[1]


def _span_buckets(part: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bucket identifiers of part[begin:stop], 62 bits; equal bytes give equal ones wherever they stand."""
    out = np.zeros(len(begin), np.int64)
    for k, prime in enumerate(_PRIMES):
        up, down = _prime_powers(k)
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(_TABLES[k][part] * up[: len(part)] % prime, out=total[1:])
        out = out << 31 | (total[stop] - total[begin]) % prime * down[begin] % prime
    return mix(out.view(U64) + (stop - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def _gram_buckets(data: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of all q-grams, by doubling: a bucket of 2k bytes is that of k bytes and that k later."""
    h = _TABLE[data]
    width, left, done, base = 1, q, None, 0xBF58476D1CE4E5B9
    while True:
        if left & width:
            part = h if done is None else None
            if done is None:
                done, covered = part, width
            else:
                n = min(len(done), len(h) - covered)
                done = done[:n] * U64(base | 1) + h[covered : covered + n]
                done ^= done >> U64(31)
                covered += width
        if width * 2 > left:
            break
        n = len(h) - width
        h = h[:n] * U64(base) + h[width:]
        h ^= h >> U64(31)
        width *= 2
        base = (base * 0x94D049BB133111EB + 2) % 2**64 | 1
    return done[: len(data) - q + 1] * U64(0x94D049BB133111EB)


def _entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, q: int):
    """Entries of consecutive documents: document row, gram bucket, span bucket, gram, first and last window start.

    Positions are relative to the document.
    """
    out = []
    for i, j in doc_chunks(starts, ends, _CHUNK):
        lo, hi = int(starts[i]), int(ends[j - 1])
        step = _CHUNK if j == i + 1 else max(hi - lo, 1)
        at = lo
        while at + length <= hi:
            end = min(at + step + length - 1, hi)  # windows that start in [at, at + step)
            part = data[at:end]
            g = _gram_buckets(part, q)
            order = (g & ~U64(2 * _CHUNK - 1)) | np.arange(len(g), dtype=U64)
            gram = (sliding_min(order, length - q + 1) & U64(2 * _CHUNK - 1)).astype(np.int64)
            place = at + np.arange(len(gram))
            doc = i + np.searchsorted(ends[i:j], place, side="right") if j > i + 1 else np.full(len(gram), i)
            inside = (doc < j) & (place + length <= ends[np.minimum(doc, j - 1)]) & (place >= starts[np.minimum(doc, j - 1)])
            first = inside.copy()
            first[1:] &= ~(inside[:-1] & (gram[1:] == gram[:-1]) & (doc[1:] == doc[:-1]))
            begin = np.flatnonzero(first)
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
            stop = np.flatnonzero(last)
            if len(begin):
                span = _span_buckets(part, begin, stop + length)
                d = doc[begin]
                shift = at - starts[d]
                out.append((d, g[gram[begin]], span, gram[begin] + shift, begin + shift, stop + shift))
            at += step
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, U64, U64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _entry_table(docs: DataFrame, key_type: str, length: int, q: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, gram_bucket, span_bucket, gram, first, last = _entries(*utf8_views(part.column(1)), length, q)
                ints = [pa.array(x.astype(np.int32)) for x in (gram, first, last)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(gram_bucket.view(np.int64)), pa.array(span_bucket.view(np.int64)), *ints], ["key", "gram", "span", "at", "first", "last"])

    return docs.mapInArrow(thrifty(run), f"key {key_type}, gram long, span long, at int, first int, last int")


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def _finish_buckets(length: int, key_type: str):
    """Rows (bucket, key, start, low, text) sorted by bucket, key and start: which windows of text start earlier too."""

    def run(batches):
        bucket, seen = None, set()
        for batch in batches:
            keep, first, last = [], [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for k, (own, start, text) in enumerate(rows):
                if own != bucket:
                    bucket, seen = own, set()
                windows = [text[i : i + length] for i in range(len(text) - length + 1)]
                again = [i for i, w in enumerate(windows) if w in seen]
                seen.update(windows)
                if again:
                    a, b = _runs(np.array(again))
                    keep += [k] * len(a)
                    first += (a + start).tolist()
                    last += (b + start).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "first", "last"])

    return run


def _refine(length: int):
    """Rows of crowded buckets halved by offset: a new bucket identifier for the bytes all windows of the half share.

    Offsets are those of the gram within the window; [low, high] is the bucket's range of them.
    """

    def run(batches):
        for batch in batches:
            source, cols = [], ([], [], [], [], [], [])
            for k, (bucket, at, start, text, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    # windows of this entry whose gram offset (at - start) is in [a, b]
                    lo, hi = max(start, at - b), min(start + len(text) - length, at - a)
                    if a > b or lo > hi:
                        continue
                    shared = text[at - a - start : at - b + length - start]
                    digest = hashlib.blake2b(shared + bytes([a & 255, b & 255]) + bucket, digest_size=16).digest()
                    source.append(k)
                    for c, v in zip(cols, (digest, at, lo, text[lo - start : hi + length - start], a, b)):
                        c.append(v)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
            made = [pa.array(c, t) for c, t in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([made[0], batch.column(1).take(pa.array(source, pa.int64())), *made[1:]], ["bucket", "key", "at", "start", "text", "low", "high"])

    return run


def _compare_spans(spans: DataFrame, key_type: str, length: int, q: int, dense: int) -> list[DataFrame]:
    """key, first, last: windows of rows (bucket, key, at, start, text) that start earlier in the same bucket."""
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = f"bucket binary, key {key_type}, at int, start int, text binary, low int, high int"
    todo = spans.withColumns({"low": F.lit(0), "high": F.lit(length - q)})
    out = []
    while True:
        crowded = materialize(todo.groupBy("bucket").count().filter(F.col("count") > dense).select("bucket"), "crowded")
        none = crowded.isEmpty()
        few = crowded if none else small_side(crowded, 200_000)
        calm = todo if none else todo.join(few, "bucket", "left_anti")
        done = calm.select("bucket", "key", "start", "text").repartition(n, "bucket").sortWithinPartitions("bucket", "key", "start")
        out.append(done.mapInArrow(thrifty(_finish_buckets(length, key_type)), f"key {key_type}, first int, last int"))
        if none:
            return out
        hot = todo.join(few, "bucket", "left_semi").select("bucket", "key", "at", "start", "text", "low", "high")
        single = hot.filter("low = high")  # the bucket is one window
        if not single.isEmpty():
            lows = single.groupBy("bucket").agg(F.min(F.struct("key", "start")).alias("least"))
            later = single.join(lows, "bucket").filter(F.struct("key", "start") > F.col("least"))
            out.append(later.select("key", F.col("start").alias("first"), F.col("start").alias("last")))
        todo = materialize(hot.filter("low < high").mapInArrow(thrifty(_refine(length)), shape), "refined")
        lone = todo.groupBy("bucket").count().filter("count > 1").select("bucket")
        todo = todo.join(lone, "bucket", "left_semi")


def _key(docs: DataFrame, id_col: str, text_col: str):
    """The key of a row where ids repeat or are null: the id with a hash of the text."""
    return F.struct(column(id_col).alias("id"), F.sha2(F.coalesce(column(text_col), F.lit("")), 256).alias("sha"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """key and text, one row per key, and whether the key is the id with a hash of the text."""
    if not has_repeated_ids(docs, id_col):
        return docs.select(column(id_col).alias("key"), column(text_col).alias("text")), False
    return docs.select(_key(docs, id_col, text_col).alias("key"), column(text_col).alias("text")).dropDuplicates(["key"]), True


def repeated_spans(keyed: DataFrame, *, length: int = LENGTH, gram: int = GRAM, dense: int = DENSE) -> DataFrame:
    """key and spans (sorted, disjoint [start, end) byte ranges to remove) of the rows that lose anything, written.

    keyed has columns key and text, one text per key.
    """
    with scratch() as keep:
        return keep(_repeated_spans(keyed, length, gram, dense))


def _repeated_spans(keyed: DataFrame, length: int, gram: int, dense: int) -> DataFrame:
    key_type = keyed.schema["key"].dataType.simpleString()
    entries = materialize(_entry_table(keyed, key_type, length, gram), "entries")
    shared = []
    for k in range(SLICES):  # a slice of the buckets at a time, so their shuffles are not all on disk at once
        part = entries.filter(F.pmod("gram", F.lit(SLICES)) == k)
        # written, not joined in place: a join of two plain exchanges is one whose hot grams can be split
        again = materialize(part.groupBy("gram").count().filter("count > 1").select("gram"), "repeated-grams")
        shared.append(drop_finished(materialize(part.join(again, "gram", "left_semi"), "shared-grams")))
    shared = reduce(DataFrame.union, shared)
    release(entries)
    span = ["gram", "span"]
    least = shared.groupBy(*span).agg(F.min(F.struct("key", "first", "last", "at")).alias("least"), F.count("*").alias("n"))
    least = materialize(least, "spans")
    # entries whose whole span stands earlier
    same = least.filter("n > 1").select(*span, F.col("least.key").alias("k0"), F.col("least.first").alias("f0"))
    whole = shared.join(same, span).filter(F.struct("key", "first") > F.struct(F.col("k0").alias("key"), F.col("f0").alias("first")))
    parts = [whole.select("key", "first", "last")]
    # earliest entries of different spans with one gram
    several = materialize(least.groupBy("gram").count().filter("count > 1").select("gram"), "rival-grams")
    rivals = least.join(several, "gram", "left_semi").select("gram", "least.*")
    wanted = rivals.groupBy("key").agg(F.collect_list(F.struct("gram", "at", "first", "last")).alias("wanted"))
    both = keyed.join(wanted, "key")

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                want = part.column(2)
                counts = pc.list_value_length(want).to_numpy()
                flat = want.flatten()
                g, at, first, last = (flat.field(k).to_numpy() for k in range(4))
                row = np.repeat(np.arange(part.num_rows), counts)
                data, starts, _ = utf8_views(part.column(1))
                a, n = starts[row] + first, last - first + length
                text = data[np.repeat(a, n) + ranges(n)]
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(text.tobytes())])
                grams = pa.array([x.tobytes() for x in g], pa.binary())
                yield pa.RecordBatch.from_arrays([grams, part.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(first.astype(np.int32)), texts], ["bucket", "key", "at", "start", "text"])

    spans = both.select("key", "text", "wanted").mapInArrow(thrifty(cut), f"bucket binary, key {key_type}, at int, start int, text binary")
    spans = materialize(spans, "rival-spans")
    parts += _compare_spans(spans, key_type, length, gram, dense)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    listed = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))

    def merge(batches):
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                own: list[list[int]] = []
                for r in runs:
                    if own and r["first"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], r["last"] + length)
                    else:
                        own.append([r["first"], r["last"] + length])
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["key", "spans"])

    return materialize(listed.mapInArrow(thrifty(merge), f"key {key_type}, spans array<array<int>>"), "removed-spans")


def _with_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, str]:
    """docs with a column of spans (null if nothing is removed), the last one, and its name."""
    key, name = free_names(docs, "key", "spans")
    keyed, by_text = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, **options).toDF(key, name)
    size = spans.agg(F.sum(F.size(name) + 4)).first()[0] or 0
    if size <= SPAN_CELLS:
        spans = F.broadcast(spans)
    mine = _key(docs, id_col, text_col) if by_text else column(id_col)
    return docs.join(spans, mine == F.col(key), "left").drop(key), name


def _kept(raw: bytes, spans) -> bytes:
    at, out = 0, []
    for a, b in spans or ():
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def removal_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw, spans = (text.as_py() or "").encode("utf-8", "surrogatepass"), spans.as_py() or []
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both, _ = _with_spans(docs.select(column(id_col), column(text_col)), id_col, text_col, **options)
    return both.mapInArrow(thrifty(run), f"{ddl_name(id_col)} {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """docs with the repeated bytes cut out of the text, and the count of characters set anew if there is one.

    A character that is cut in part goes whole. Rows stay, even if their text becomes empty.
    """
    both, _ = _with_spans(docs, id_col, text_col, **options)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    chars_type = docs.schema[chars_col].dataType.simpleString() if chars is not None else ""
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(last)):
                t, s = text.as_py(), spans.as_py()
                texts.append(t if not s else _kept(t.encode("utf-8", "surrogatepass"), s).decode("utf-8", "ignore"))
            columns = [batch.column(k) for k in range(batch.num_columns) if k != last]
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None and chars_type in ("bigint", "int"):
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])

    return map_rows(both, run, docs)
