"""Alignment of two tokenizers over every text, and how often their tokens are linked in the corpus.

A space and the text is encoded by a byte-level BPE (A), the text by a piece model that adds the space itself (B). Both
sequences cover the same bytes. The byte ranges of the B tokens, in order, are a static interval index: two bisections by
the start and the end of an A token stab it and give the run of B tokens that it overlaps. A gap between neighbouring B
tokens that no A token spans becomes a group boundary; tokens of both sides between two boundaries are a group, and every
A token of a group is linked with every B token of it. Steps are taken for a slice of documents at once: ends of documents
are boundaries like any other.

The count of an id pair is the number of documents that hold it linked. Texts are encoded once. A task gathers documents
into chunks of about CHUNK pairs and writes, for each chunk, its distinct pairs with their numbers of documents, and for
each document the places of its pairs in that list with their numbers of links. So what is shuffled by pair is one row for
each chunk that has it, however many documents do, and a pair of every document is still a row of every chunk only. The
counts come back by chunk, in the order of the list, to the documents of the chunk. The highest count of each A id is one
row for each id of the vocabulary and is broadcast.

Defined results: a null or empty text, and one whose joined bytes differ from space and text for A or B, has no tokens,
zeros and an empty digest; the string of a special token inside a text is plain text; every row is a document of its own,
whatever its id; an empty table gives an empty result; other columns are ignored, whatever their names. A task holds one
chunk; a single document is held whole with its distinct pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .bpe import tokenizer
from .common import column, ddl_name, materialize, ranges, thrifty

#: Pairs of documents that a chunk gathers, about.
CHUNK = 1 << 21
#: Documents aligned at once.
SLICE = 256
#: Links of a group from which equal ids of the group are brought together before pairs are made.
DENSE = 1 << 10


class Aligner:
    """Both tokenizers, the bytes of their tokens and the text of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = tokenizer(path_a).core
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known = tokenizer(path_a).bytes_of
        bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.bytes, self.sizes, self.names = [], [], []
        for table, ends in ((bytes_a, ",|"), (bytes_b, ",;")):
            self.bytes.append(np.array(table, object))
            self.sizes.append(np.array([len(x) for x in table], np.int64))
            self.names.append(np.array([[f"{i}{c}" for i in range(len(table))] for c in ends], object))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A and by B of each text, or None where a text has no tokens."""
        out: list = [None] * len(texts)
        filled = [k for k, t in enumerate(texts) if t]
        for k, b in zip(filled, self.b.encode([texts[k] for k in filled], num_threads=1) if filled else ()):
            raw = " " + texts[k]
            a, b = self.a.encode_to_numpy(raw, allowed_special=set(), disallowed_special=()), np.array(b, np.int64)
            raw = raw.encode()
            if b"".join(self.bytes[0][a].tolist()) == raw and b"".join(self.bytes[1][b].tolist()) == raw:
                out[k] = a.astype(np.int64), b
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of every token of two sequences over the same bytes."""
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # the run of B tokens that each A token overlaps: the first that ends behind its start, the first that reaches its end
        first = np.searchsorted(end_b, end_a - self.sizes[0][a], "right")
        last = np.searchsorted(end_b, end_a, "left")
        spanned = np.cumsum(np.bincount(first, minlength=len(b)) - np.bincount(last, minlength=len(b))) > 0
        group_b = np.concatenate([[0], np.cumsum(~spanned)[:-1]])
        return group_b[first], group_b

    def digest_text(self, a, b, group_a, group_b) -> np.ndarray:
        """Texts of the ids, each with the sign behind it, in the order of the digest."""
        n = int(group_b[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = self.names[0][np.append(group_a[1:] != group_a[:-1], True).astype(int), a]
        out[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = self.names[1][np.append(group_b[1:] != group_b[:-1], True).astype(int), b]
        return out

    def pairs(self, a, b, group_a, group_b, doc_a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (id of A times the size of B's vocabulary plus id of B) and number of links, sorted."""
        n, many = int(group_b[-1]) + 1, len(self.sizes[1])
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        dense = in_a * in_b > DENSE
        own = np.flatnonzero(~dense[group_a])
        width = in_b[group_a[own]]
        right = np.repeat(from_b[group_a[own]], width) + ranges(width)
        docs, keys, links = [np.repeat(doc_a[own], width)], [np.repeat(a[own], width) * many + b[right]], [np.ones(len(right), np.int64)]
        for g in np.flatnonzero(dense):
            ids_a, n_a = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            keys.append((ids_a[:, None] * many + ids_b).ravel())
            links.append(np.outer(n_a, n_b).ravel())
            docs.append(np.full(len(keys[-1]), doc_a[from_a[g]]))
        doc, key, link = map(np.concatenate, (docs, keys, links))
        order = np.argsort(doc * (len(self.sizes[0]) * many) + key, kind="stable")
        doc, key, link = doc[order], key[order], link[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
        return doc[new], key[new], np.add.reduceat(link, new) if len(new) else link


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """Both tokenizers, loaded once by each Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _align(path_a: str, path_b: str, chunk: int):
    """Rows of documents and of chunks; either kind leaves the columns of the other null."""

    def run(batches):
        t, kind, number = aligner(path_a, path_b), None, TaskContext.get().partitionId() << 32
        ids, rows, sizes, keys, links, held = [], [], [], [], [], 0

        def flush():
            nonlocal number, ids, rows, sizes, keys, links, held
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            found, place, count = np.unique(flat, return_inverse=True, return_counts=True)
            place, link = place.astype("<u4"), (np.concatenate(links) if links else flat).astype("<u4")
            ends = np.cumsum(sizes)
            spans = [slice(e - s, e) for s, e in zip(sizes, ends)]
            n = len(rows)
            own = pa.concat_arrays(ids)
            yield from _batches(number, own, rows, [place[s].tobytes() for s in spans], [link[s].tobytes() for s in spans], pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()))
            yield from _batches(number, pa.nulls(1, kind), [(None,) * 5], [None], [None], pa.array([found.tobytes()]), pa.array([count.astype("<i8").tobytes()]))
            number += 1
            ids, rows, sizes, keys, links, held = [], [], [], [], [], 0

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = t.encode(part.column(1).to_pylist())
                ids.append(part.column(0))
                some = [k for k, x in enumerate(found) if x]
                made: list = [(0, 0, 0, 0, "")] * len(found)
                size = np.zeros(len(found), np.int64)
                if some:
                    a, b = (np.concatenate([found[k][side] for k in some]) for side in (0, 1))
                    n_a, n_b = (np.array([len(found[k][side]) for k in some]) for side in (0, 1))
                    group_a, group_b = t.groups(a, b)
                    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
                    groups = np.diff(group_b[end_b - 1] + 1, prepend=0)
                    text = t.digest_text(a, b, group_a, group_b)
                    ends = end_a + end_b
                    doc_a = np.repeat(np.array(some), n_a)
                    doc, key, link = t.pairs(a, b, group_a, group_b, doc_a)
                    size = np.bincount(doc, minlength=len(found))
                    linked = np.diff(np.concatenate([[0], np.cumsum(link)])[np.concatenate([[0], np.cumsum(size)])])
                    for i, k in enumerate(some):
                        sha = hashlib.sha256("".join(text[ends[i] - n_a[i] - n_b[i] : ends[i]].tolist())[:-1].encode()).hexdigest()
                        made[k] = (int(n_a[i]), int(n_b[i]), int(groups[i]), int(linked[k]), sha)
                    keys.append(key)
                    links.append(link)
                    held += len(key)
                rows += made
                sizes += size.tolist()
                if held >= chunk:
                    yield from flush()
        if rows:
            yield from flush()

    return run


def _batches(number, own, rows, places, links, pairs, counts):
    """Output batches of at most 4096 rows."""
    names = ["chunk", "id", *_NUMBERS, "sha", "places", "links", "pairs", "counts"]
    columns = list(zip(*rows))
    for at in range(0, len(rows), 4096):
        to = min(at + 4096, len(rows))
        made = [pa.array([number] * (to - at), pa.int64()), own.slice(at, to - at), *(pa.array(c[at:to], pa.int64()) for c in columns[:4]), pa.array(columns[4][at:to], pa.string())]
        yield pa.RecordBatch.from_arrays([*made, pa.array(places[at:to], pa.binary()), pa.array(links[at:to], pa.binary()), pairs.slice(at, to - at), counts.slice(at, to - at)], names)


def _listed(batches):
    """The distinct pairs of chunks as rows: chunk, place, pair, documents."""
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(k) for k in range(3))):
            pairs, counts = np.frombuffer(pairs.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<i8")
            for at in range(0, len(pairs), 1 << 16):
                own = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk.as_py())), pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array(own), pa.array(counts[at : at + len(own)])], ["chunk", "place", "pair", "n"])


def link_digests(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum (of
    counts over links) and groups_sha256."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("chunk", LongType()), StructField("id", id_type), *(StructField(c, LongType()) for c in _NUMBERS), StructField("sha", StringType()), *(StructField(c, BinaryType()) for c in ("places", "links", "pairs", "counts"))])
    done = materialize(docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(thrifty(_align(path_a, path_b, chunk)), schema), "aligned")
    listed = done.filter("pairs is not null").select("chunk", "pairs", "counts").mapInArrow(thrifty(_listed), "chunk long, place int, pair long, n long")
    many = len(aligner(path_a, path_b).sizes[1])
    counts = materialize(listed.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    # one row for each id of A's vocabulary
    highest = counts.groupBy(F.expr(f"pair div {many}").alias("a")).agg(F.max("count").alias("most"))
    rated = counts.withColumn("a", F.expr(f"pair div {many}")).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    found = listed.select("chunk", "place", "pair").join(rated, "pair").select("chunk", "place", "count", "best")
    aligned = done.filter("places is not null").select("chunk", "id", *_NUMBERS, "sha", "places", "links")

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of a chunk with the counts of its pairs."""
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        places, links = (np.frombuffer(b"".join(left.column(c).to_pylist()), "<u4") for c in ("places", "links"))
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in left.column("places").to_pylist()])])
        sums = [np.concatenate([[0], np.cumsum(links * by[places])])[ends] for by in (best, count)]
        made = [left.column("id"), *(left.column(c) for c in _NUMBERS), *(pa.array(np.diff(s), pa.int64()) for s in sums), left.column("sha")]
        return pa.table(made, [id_col, *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    out = f"{ddl_name(id_col)} {id_type.simpleString()}, " + ", ".join(f"{c} long" for c in (*_NUMBERS, "n_best", "count_sum")) + ", groups_sha256 string"
    return aligned.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(rate, out)
