"""Token ids in files: frequency-ranked, byte-aligned codes of variable length with separate control bytes.

Ids are replaced by their rank in the corpus (the most frequent id is 0), and every rank takes 1 to 4 bytes, least
significant first. The lengths stand apart from the data: a control byte holds those of four ids, two bits each, the
first in the lowest bits. A reader looks a control byte up in a table of 256 rows of four lengths; sums of these give the
place of every code, so NumPy decodes a block without a loop over ids.

The folder holds two Parquet tables, so that Spark's committer makes only whole tasks visible and any store that Spark
reaches will do: ranks (rank, id) with every id of the vocabulary, and blocks (part, block, before, ids, sizes, control,
data). A block has whole documents in ascending order of id, about BLOCK ids of them; before counts the ids of its part
ahead of it. control and data are columns of their own, so a reader of sizes alone reads neither.

One pass encodes texts, writes ids and counts them by task; counts are summed by id, so the driver sees one number for
each id of the vocabulary. The documents are then dealt out by ranges of (id, checksum, row): where one id has most rows,
they still spread over ranges. Each range becomes a part, and the start of a document is the sum of whole parts before
(one number a part), of blocks before and of documents before it in the block.

Defined results: a null or empty text has the end id alone; rows with a null id come first; rows with one id are ordered
by checksum of their ids, and equal rows are interchangeable; the string of a special token inside a text is that token;
an empty table gives empty files and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..storage import _delete, shared_dir
from .bpe import tokenizer
from .common import column, thrifty, utf8_views

#: Ids of a block, about; a longer document is a block of its own.
BLOCK = 1 << 16
#: Documents encoded between two output batches.
SLICE = 1024

#: The four lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    spare = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = spare
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control, values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= spare[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of pack()."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _binary(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of one value for each array of bytes."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _encode(path: str, end_id: int, size: int, width: str):
    """Encoder of (id, text) batches: id, row, check, ids as bytes; the last row of a task has its counts instead."""

    def run(batches):
        t, counts = tokenizer(path), np.zeros(size, np.int64)
        row, kind = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [t.encode_array(x) for x in part.column(1).to_pylist()]
                ends = np.cumsum([len(x) + 1 for x in found])
                flat = np.full(int(ends[-1]), end_id, width)
                for x, e in zip(found, ends):
                    flat[e - 1 - len(x) : e - 1] = x
                counts += np.bincount(flat, minlength=size)
                raw = [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
                n = len(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(row, row + n)), pa.array([zlib.crc32(x) for x in raw], pa.int64()), _binary(raw), pa.nulls(n, pa.binary())], ["id", "row", "check", "codes", "counts"])
                row += n
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.nulls(1, pa.binary()), _binary([counts.astype("<i8")])], ["id", "row", "check", "codes", "counts"])

    return run


def _id_counts(batches):
    """Counts of a task as rows of id and count."""
    for batch in batches:
        for raw in batch.column(0):
            counts = np.frombuffer(raw.as_py(), "<i8")
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["token", "count"])


def _write_blocks(rank: np.ndarray, width: str, block: int):
    """Writer of sorted (id, codes) batches of one range."""

    def run(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, raws, held = [], [], 0

        def flush():
            sizes = [len(x) // np.dtype(width).itemsize for x in raws]
            control, data = pack(rank[np.frombuffer(b"".join(raws), width)])
            own = pa.concat_arrays(ids)
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.array([sizes], pa.list_(pa.int64())), _binary([control]), _binary([data])]
            return sum(sizes), pa.RecordBatch.from_arrays(cols, ["part", "block", "before", "ids", "sizes", "control", "data"])

        for batch in batches:
            codes, at = batch.column(1), 0
            _, starts, ends = utf8_views(codes)
            sizes = (ends - starts) // np.dtype(width).itemsize
            for k in range(batch.num_rows):
                held += int(sizes[k])
                if held >= block or k == batch.num_rows - 1:
                    ids.append(batch.column(0).slice(at, k + 1 - at))
                    raws += [x.as_py() for x in codes.slice(at, k + 1 - at)]
                    at = k + 1
                if held >= block:
                    n, out = flush()
                    yield out
                    number, before, ids, raws, held = number + 1, before + n, [], [], 0
        if raws:
            yield flush()[1]

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block: int = BLOCK) -> str:
    """Encode docs into the files of a folder (a new one in the shared folder unless given) and return it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    size = max(max(tokenizer(tokenizer_path).bytes_of), end_id) + 1
    width = "<u2" if size <= 1 << 16 else "<u4"
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("id", id_type), StructField("row", LongType()), StructField("check", LongType()), StructField("codes", BinaryType()), StructField("counts", BinaryType())])
    encoded = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(thrifty(_encode(tokenizer_path, end_id, size, width)), schema)
    # ids have few bits to a byte, which a coder of single bytes leaves in; these are most of the disk
    encoded.write.option("compression", "zstd").parquet(f"{folder}/ids")
    encoded = spark.read.schema(schema).parquet(f"{folder}/ids")
    counts = encoded.filter("counts is not null").select("counts").mapInArrow(_id_counts, "token long, count long")
    # at most one row for each id of the vocabulary
    found = counts.groupBy("token").agg(F.sum("count").alias("count")).collect()
    seen = np.zeros(size, np.int64)
    for r in found:
        seen[r.token] = r["count"]
    order = np.lexsort((np.arange(size), -seen))
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(size)), "id": pa.array(order)})).coalesce(1).write.parquet(f"{folder}/ranks")
    keys = [F.col("id").asc_nulls_first(), "check", "row"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded.filter("codes is not null").select("id", "check", "row", "codes").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out = StructType([StructField("part", IntegerType()), StructField("block", IntegerType()), StructField("before", LongType()), StructField("ids", ArrayType(id_type)), StructField("sizes", ArrayType(LongType())), StructField("control", BinaryType()), StructField("data", BinaryType())])
    dealt.select("id", "codes").mapInArrow(thrifty(_write_blocks(rank, width, block)), out).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    _delete(spark, f"{folder}/ids")
    return folder


def _blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Blocks with the place of their first id in the whole, and the id of every rank."""
    order = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toArrow().column("id").to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row for each part, of which there are no more than shuffle partitions
    ahead = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(ahead), "part").withColumn("first", F.col("ahead") + F.col("before")), order.astype(np.uint32)


def _read(folder_order: np.ndarray, make, kind: pa.DataType, name: str, id_col: str):
    """Reader of blocks: id, start, n_tokens and what make(ids, firsts, ends) gives for each document."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first, own = batch.column("first")[k].as_py(), batch.column("ids")[k].values
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                control, data = (np.frombuffer(batch.column(c)[k].as_py(), np.uint8) for c in ("control", "data"))
                ids = folder_order[unpack(control, data, int(ends[-1]))]
                yield pa.RecordBatch.from_arrays([own, pa.array(first + ends - sizes), pa.array(sizes), pa.array(make(ids, ends - sizes, ends), kind)], [id_col, "start", "n_tokens", name])

    return run


def read_tokens(spark: SparkSession, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: its id, start (ids of all documents before it), n_tokens and ids (array of int)."""
    blocks, order = _blocks(spark, folder)
    schema = StructType([StructField(id_col, blocks.schema["ids"].dataType.elementType), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])
    run = _read(order, lambda ids, a, b: [ids[i:j].astype(np.int32) for i, j in zip(a, b)], pa.list_(pa.int32()), "ids", id_col)
    return blocks.select("first", "ids", "sizes", "control", "data").mapInArrow(thrifty(run), schema)


def file_digests(spark: SparkSession, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """read_tokens() reduced inside the same task: ids_crc32 of the ids as little-endian unsigned 32-bit numbers."""
    blocks, order = _blocks(spark, folder)
    schema = StructType([StructField(id_col, blocks.schema["ids"].dataType.elementType), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])

    def crc(ids, a, b):
        ids = np.ascontiguousarray(ids, "<u4")
        return [zlib.crc32(ids[i:j]) for i, j in zip(a, b)]

    return blocks.select("first", "ids", "sizes", "control", "data").mapInArrow(thrifty(_read(order, crc, pa.int64(), "ids_crc32", id_col)), schema)
