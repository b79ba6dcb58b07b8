"""Pieces shared by the training-data operators: shared storage and byte-level array code.

The array code works on the raw UTF-8 buffers of Arrow columns. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import release, scratch  # noqa: F401
from ..storage import written as materialize

U64 = np.uint64

# ---------------------------------------------------------------- shared storage


#: Rows of at most this many (each of a few numbers) may be sent whole to every executor.
BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized df, with a broadcast hint if it has at most max_rows rows; else the planner shuffles it.

    Only for rows of a few numbers. The result of a join is the same either way.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def thrifty(run):
    """run for mapInArrow, followed by handing freed memory back: workers are used again by later stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


# ---------------------------------------------------------------- Arrow columns as arrays


def utf8_views(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    if n == 0 or offs is None:
        z = np.zeros(n, np.int64)
        return np.zeros(0, np.uint8), z, z
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = offs[:-1], offs[1:].copy()
    if col.null_count:
        null = np.asarray(col.is_null())
        ends[null] = starts[null]
    return data, starts, ends


def doc_chunks(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Ranges (i, j) of consecutive documents with about limit bytes each, one document at least."""
    i, n = 0, len(starts)
    sizes = ends - starts
    while i < n:
        j, total = i + 1, int(sizes[i])
        while j < n and total + int(sizes[j]) <= limit:
            total += int(sizes[j])
            j += 1
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(42)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        out = np.empty(size, U64)
        out[0] = 1
        k = 1
        while k < size:
            m = min(k, size - k)
            out[k : k + m] = out[:m] * U64(pow(base, k, 2**64))
            k += m
        if size <= 1 << 22:
            _powers[base] = out
        have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the splitmix64 finalizer)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[data] * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BASE_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes that word_tables() handles at once; a longer document goes piece by piece, cut at white space.
PIECE = 1 << 18


def _words(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each lower-cased word; documents begin at doc_starts."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = doc_starts[doc_starts < len(data)]
    first[begins] = inside[begins]
    last = np.zeros(len(data) + 1, bool)
    last[1:] = inside
    last[1:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return span_hashes(low, s, e), s, e


def word_table(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive documents and the index of the first word of each.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased. The second array has one
    more entry than there are documents. Whole texts are used, whatever their length.
    """
    hashes, counts = [], np.zeros(len(starts), np.int64)
    for i, j in doc_chunks(starts, ends, PIECE):
        lo, hi = int(starts[i]), int(ends[j - 1])
        if j == i + 1 and hi - lo > PIECE:
            at = lo
            while at < hi:
                to = min(at + PIECE, hi)
                while to < hi and not _SPACE[data[to]]:
                    space = np.flatnonzero(_SPACE[data[to : to + 4096]])
                    to = to + int(space[0]) if len(space) else min(to + 4096, hi)
                h, _, _ = _words(data[at:to], np.zeros(1, np.int64))
                hashes.append(h)
                counts[i] += len(h)
                at = to
        elif hi > lo:
            # null rows may leave unused bytes between documents, so the texts are packed first when needed
            if int((ends[i:j] - starts[i:j]).sum()) != hi - lo:
                part = np.concatenate([data[a:b] for a, b in zip(starts[i:j], ends[i:j])])
                begins = np.concatenate([[0], np.cumsum(ends[i:j] - starts[i:j])[:-1]])
            else:
                part, begins = data[lo:hi], starts[i:j] - lo
            h, s, _ = _words(part, begins)
            hashes.append(h)
            bounds = np.concatenate([np.searchsorted(s, begins), [len(s)]])
            counts[i:j] += np.diff(bounds)
    first = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; entry i covers words i .. i + k - 1."""
    if len(words) < k:
        return np.zeros(0, U64)
    n = len(words) - k + 1
    h = np.zeros(n, U64)
    for j in range(k):
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) + words[j : j + n]
    return mix(h)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w entries."""
    k = 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (w - k)], v[w - k :]) if k < w else v


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each c of counts, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def has_repeated_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands in more than one row."""
    rows = docs.select(F.col(id_col).alias("id")).groupBy("id").count().filter((F.col("count") > 1) | F.col("id").isNull())
    return not rows.isEmpty()


def free_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as it takes to be no column of docs in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def column(name: str):
    """The column of this very name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ddl_name(name: str) -> str:
    """The name as it stands in a schema string."""
    return "`" + name.replace("`", "``") + "`"


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own in every row, written, so that each reader finds the same numbers; and its column."""
    (row,) = free_names(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows"), row


def rows_with(docs: DataFrame, name: str, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of docs with a table of one column of keys; columns and their order stay."""
    (key,) = free_names(docs, "key")
    return docs.join(keys.toDF(key), column(name) == F.col(key), how)


def map_rows(df: DataFrame, run, like: DataFrame) -> DataFrame:
    """df.mapInArrow(run) with the columns of like, whatever their names: inside, column k is called ck."""
    schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(like.schema.fields)])
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(thrifty(run), schema).toDF(*like.columns)


def drop_finished(df: DataFrame) -> DataFrame:
    """df, after a collection on the driver: Spark deletes the shuffle files of steps that nothing refers to any more."""
    df.sparkSession._jvm.System.gc()
    return df
