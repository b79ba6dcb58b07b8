"""Benchmark decontamination with spaced-seed hashing.

Texts are sequences of lower-cased words. A mask is a pattern of positions that count and positions that are ignored;
the hash of the counted words at every offset is a seed. Seeds of all benchmark items are joined with the seeds of all
documents, and each hit fixes a diagonal (document offset minus item offset), which is verified by counting equal words
over the whole overlap. Where that is not similar enough, the diagonals of a document and an item that are near enough
for one window to cross them are judged together: a window follows one diagonal and may change to another, and every
word that a change leaves out on either side counts as one that is not equal.

A document is contaminated by an item if some window, wherever it begins and ends in the item and the document, has at
least min(item words, MIN_WORDS) item words and at least SIMILARITY of it is equal. Items of fewer words than the
shortest mask are matched as they stand: they are seeded by all of their words.

The benchmark is a stated query set: it is read in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters, and
each block goes over all documents. One block is sent to the executors at a time: of a benchmark of several blocks the
leaks of a block are written before the next is fetched, so neither the driver nor an executor ever holds two.

Defined results: null texts and items count as empty and match nothing; an item of no words matches nothing; repeated
items and rows are each reported, with null ids as they are; ids may be of any type; empty tables give empty results;
other columns, whatever their names, are ignored by find_leaks() and kept by drop_contaminated().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, column, ddl_name, doc_chunks, has_repeated_ids, materialize, mix, numbered_rows, ranges, rows_with, scratch, small_side, thrifty, utf8_views, word_table

#: Fixed masks. At the similarity below, an overlap of 13 or more words has few ways to miss all of them.
MASKS = ("1111", "11011", "1101011", "110101", "1100101")
SIMILARITY = 0.8
MIN_WORDS = 13
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
#: Hits expanded at once, and bytes of documents searched at once.
HITS = 1 << 20
CHUNK = 1 << 20


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every offset where the mask fits."""
    if len(words) < len(mask):
        return np.zeros(0, U64)
    n = len(words) - len(mask) + 1
    h = np.full(n, sum(2**k for k, c in enumerate(mask) if c == "1"), U64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) + words[k : k + n]
    return mix(h)


class SeedIndex:
    """Seeds of a block of benchmark items, sorted, with item and offset."""

    def __init__(self, texts: list[str | None], masks: tuple[str, ...] = MASKS):
        self.words, self.first = word_table(*utf8_views(pa.array(texts, pa.string())))
        self.lengths = np.diff(self.first)
        shortest = min(map(len, masks))
        self.tables = []
        short = {"1" * int(n) for n in set(self.lengths[(self.lengths > 0) & (self.lengths < shortest)].tolist())}
        for mask in (*masks, *sorted(short)):
            rows = [k for k, n in enumerate(self.lengths) if (n == len(mask) if mask in short else n >= len(mask))]
            keys = [seeds(self.words[self.first[k] : self.first[k + 1]], mask) for k in rows]
            if not rows:
                continue
            key = np.concatenate(keys)
            item = np.repeat(np.array(rows), [len(x) for x in keys])
            at = ranges(np.array([len(x) for x in keys]))
            order = np.argsort(key, kind="stable")
            key, item, at = key[order], item[order], at[order]
            bits = max(16, int(4 * len(key)).bit_length())
            hit = np.zeros(1 << bits, bool)
            hit[(key >> U64(64 - bits)).astype(np.int64)] = True
            self.tables.append((mask, key, item, at, bits, hit))

    def search(self, words: np.ndarray, first: np.ndarray, similarity: float, min_words: int):
        """Document row, item row, offset of the item in the document, start, end, equal words of every leak."""
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for mask, key, item, at, bits, hit in self.tables:
            own = seeds(words, mask)
            pos = np.flatnonzero(hit[(own >> U64(64 - bits)).astype(np.int64)])
            pos = pos[doc_of[pos] == doc_of[pos + len(mask) - 1]]
            lo, hi = np.searchsorted(key, own[pos]), np.searchsorted(key, own[pos], side="right")
            n = hi - lo
            # hits of common seeds, a bounded number at a time; what they have in common goes at once
            bound = np.cumsum(n)
            begin = 0
            while begin < len(pos):
                stop = max(begin + 1, int(np.searchsorted(bound, (bound[begin - 1] if begin else 0) + HITS, side="right")))
                part, m = slice(begin, stop), n[begin:stop]
                row = np.repeat(lo[part], m) + ranges(m)
                own_pos = np.repeat(pos[part], m)
                found.append(np.unique(np.stack([own_pos - at[row], item[row], doc_of[own_pos]]), axis=1))
                begin = stop
        if not found:
            return np.zeros((6, 0), np.int64)
        diagonal, item, doc = np.unique(np.concatenate(found, axis=1), axis=1)
        start = np.maximum(diagonal, first[doc])
        end = np.minimum(diagonal + self.lengths[item], first[doc + 1])
        equal = np.zeros(len(doc), np.int64)
        for lo in range(0, len(doc), 20_000):  # whole overlaps, a slice of the hits at a time
            part = slice(lo, lo + 20_000)
            n = (end - start)[part]
            k = np.repeat(np.arange(len(n)), n)
            at = np.repeat(start[part], n) + ranges(n)
            same = words[at] == self.words[at - np.repeat(diagonal[part], n) + np.repeat(self.first[item[part]], n)]
            equal[part] = np.bincount(k[same], minlength=len(n))
        overlap = end - start
        ok = (overlap >= np.minimum(self.lengths[item], min_words)) & (equal >= similarity * overlap - 1e-9)
        out = [np.stack([doc, item, diagonal - first[doc], start - first[doc], end - first[doc], equal])[:, ok]]
        # diagonals that one window can cross: a change of g leaves out g words
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal, equal, ok = (x[order] for x in (doc, item, diagonal, equal, ok))
        far = (np.diff(diagonal) > _reach(self.lengths[item[1:]], similarity)) | (np.diff(doc) != 0) | (np.diff(item) != 0)
        begin = np.concatenate([[0], np.flatnonzero(far) + 1]) if len(doc) else np.zeros(0, np.int64)
        if len(begin):
            enough = np.add.reduceat(equal, begin) >= similarity * np.minimum(self.lengths[item[begin]], min_words) - 1e-9
            enough &= ~np.logical_or.reduceat(ok, begin)
            stop = np.append(begin[1:], len(doc))
            for a, b in zip(begin[enough].tolist(), stop[enough].tolist()):
                d, k = int(doc[a]), int(item[a])
                window = best_window(words[first[d] : first[d + 1]], self.words[self.first[k] : self.first[k + 1]], diagonal[a:b] - first[d], similarity, min_words)
                if window:
                    out.append(np.array([d, k, *window])[:, None])
        return np.concatenate(out, axis=1)


def _reach(length, similarity: float):
    """Most words that changes of diagonal may leave out in a window of an item of so many words."""
    return np.ceil(length * (1 - similarity) / similarity).astype(np.int64)


def best_window(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray, similarity: float, min_words: int):
    """Diagonal, start, end and equal words of the longest window along the diagonals (ascending), or None.

    Windows of many starts in the item grow together, one item word at a time; of those with one start and one diagonal
    the one with the most to spare is kept.
    """
    n, m, k = len(item), min(len(item), min_words), len(diagonals)
    place = np.arange(n)[:, None] + diagonals
    same = (place >= 0) & (place < len(words))
    same &= words[np.clip(place, 0, len(words) - 1)] == item[:, None]
    # a window is made of pieces of m to 2m - 1 item words, one of them similar enough
    lost = np.concatenate([[0], np.cumsum(~same.any(1))])
    if (lost[m:] - lost[:-m]).min() > (1 - similarity) * (2 * m - 1) + 1e-9:
        return None
    step = np.diff(diagonals)
    column = np.arange(k)
    best = None
    block = max(1, 500_000 // ((n + 1) * k))
    for low in range(0, n - m + 1, block):
        starts = np.arange(low, min(low + block, n - m + 1))
        line = np.arange(len(starts))[:, None]
        value = np.full((n + 1, len(starts), k), -np.inf)  # equal words less their due share, before item word x
        equal, origin = np.zeros(value.shape, np.int32), np.zeros(value.shape, np.int32)
        for x in range(low, n):
            v, e, o = value[x], equal[x], origin[x]
            if x <= starts[-1]:
                v[x - low], e[x - low], o[x - low] = 0, 0, column
            for j in range(k - 2, -1, -1):  # item words left out
                was = x - int(step[j])
                if was >= low:
                    spare = value[was, :, j + 1] - similarity * step[j]
                    better = spare > v[:, j]
                    v[better, j], e[better, j], o[better, j] = spare[better], equal[was, better, j + 1], origin[was, better, j + 1]
            if k > 1:  # document words left out
                level = v + similarity * diagonals
                top = np.maximum.accumulate(level, axis=1)
                source = np.maximum.accumulate(np.where(level == top, column, 0), axis=1)
                value[x], equal[x], origin[x] = top - similarity * diagonals, e[line, source], o[line, source]
                v, e, o = value[x], equal[x], origin[x]
            nxt = v + same[x] - similarity
            value[x + 1], equal[x + 1], origin[x + 1] = nxt, e + same[x], o
            done = np.argwhere((nxt >= -1e-9) & (x + 1 - starts[:, None] >= m))
            if len(done) and (best is None or x + 1 - starts[done[0, 0]] > best[0]):
                at, j = done[0]
                first = int(diagonals[o[at, j]])
                best = (x + 1 - starts[at], first, int(starts[at]) + first, x + 1 + int(diagonals[j]), int(equal[x + 1, at, j]))
    if best is None:
        return None
    _, diagonal, start, end, count = best
    return diagonal, max(start, 0), min(end, len(words)), count


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Benchmark items in blocks of bounded size, fetched one partition at a time."""
    ids, texts, chars = [], [], 0
    for i, t in benchmark.select(column(id_col), column(text_col)).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or chars + len(t or "") > BLOCK_CHARS):
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(i)
        texts.append(t)
        chars += len(t or "")
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document, item and diagonal: ids, start_word, end_word (exclusive), n_equal, n_overlap.

    The item's id keeps its name, with item_ before it if the document's id has that name.
    """
    names = [id_col, item_col if item_col.lower() != id_col.lower() else f"item_{item_col}", "start_word", "end_word", "n_equal", "n_overlap"]
    types = [docs.schema[id_col].dataType, benchmark.schema[item_col].dataType]
    schema = ", ".join(f"{ddl_name(n)} {t}" for n, t in zip(names, (*(t.simpleString() for t in types), *["long"] * 4)))
    spark = docs.sparkSession
    item_type = to_arrow_type(types[1])

    def leaks(sent):
        def run(batches):
            ids, texts = sent.value
            index, ids = SeedIndex(texts, masks), pa.array(ids, item_type)
            for batch in batches:
                data, starts, ends = utf8_views(batch.column(1))
                for lo, hi in doc_chunks(starts, ends, CHUNK):
                    words, first = word_table(data, starts[lo:hi], ends[lo:hi])
                    doc, item, _, start, end, equal = index.search(words, first, similarity, min_words)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc)), ids.take(pa.array(item)), *map(pa.array, (start, end, equal, end - start))], names)

        return docs.select(column(id_col), column(text_col)).mapInArrow(thrifty(run), schema)

    out, waiting = None, None
    for block in _blocks(benchmark, item_col, item_text_col):
        if waiting is not None:  # there are more blocks than one: each is done with before the next
            one = materialize(leaks(waiting), "leaks")
            out = one if out is None else out.union(one)
            waiting.destroy()
        waiting = spark.sparkContext.broadcast(block)
    if waiting is None:
        return spark.createDataFrame([], schema)
    return leaks(waiting) if out is None else out.union(leaks(waiting))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no leak, with all columns; rows with a null or repeated id are judged one by one."""
    with scratch() as keep:
        repeated = has_repeated_ids(docs, id_col)
        rows, key = numbered_rows(docs) if repeated else (docs, id_col)
        leaks = find_leaks(rows, benchmark, id_col=key, text_col=text_col, **options)
        bad = keep(materialize(leaks.select(column(key)).distinct(), "contaminated"))
        if repeated:
            keep(rows)
        out = rows_with(rows, key, small_side(bad), "left_anti")
        return out.drop(key) if repeated else out
