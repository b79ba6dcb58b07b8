"""Bucket-pointer refinement of every suffix, as it stands in the books; suffix.py is the form for large tables.

Every place where a gram of FIRST bytes begins is filed in the bucket of that gram, named by its earliest place. Buckets
are then refined by sorting on the bucket of the place h bytes on, h being the length that buckets agree on so far: places
with equal pairs of buckets agree on 2 h bytes and are one new bucket, and its name is what the next round reads. A place
that is alone in its bucket repeats nothing and leaves at once, and so does a place whose pointer has left. Two rounds
lead from 25 to 100 bytes. A row of every byte of the input goes through the first shuffle, which is what the README's
figures say.

Defined results: a null text counts as empty; ids are whole numbers below 2^31 and different, others raise; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, scratch, thrifty, utf8_views

#: Bytes of the first grams, and how often their length is doubled.
FIRST, ROUNDS = 25, 2


def _grams(first: int):
    """place (id * 2^32 + offset) and gram of every start in every text."""

    def run(batches):
        for batch in batches:
            data, starts, ends = utf8_views(batch.column(1))
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                n = b - a - first + 1
                if n <= 0:
                    continue
                for at in range(0, n, 1 << 18):
                    m = min(1 << 18, n - at)
                    grams = np.lib.stride_tricks.sliding_window_view(data[a + at : a + at + m + first - 1], first)
                    flat = pa.py_buffer(np.ascontiguousarray(grams).tobytes())
                    offsets = pa.py_buffer((np.arange(m + 1, dtype=np.int32) * first).tobytes())
                    place = (batch.column(0)[k].as_py() << 32) + at + np.arange(m)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.Array.from_buffers(pa.binary(), m, [None, offsets, flat])], ["place", "gram"])

    return run


def _bucketed(rows: DataFrame, *by: str) -> DataFrame:
    """place and bucket (its earliest place) of rows that share by with another."""
    own = Window.partitionBy(*by)
    rows = rows.select("place", F.min("place").over(own).alias("bucket"), F.count("*").over(own).alias("n"))
    return rows.filter("n > 1").select("place", "bucket")


def repeated_starts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, rounds: int = ROUNDS) -> DataFrame:
    """id and start of every string of first * 2 ** rounds bytes that also starts earlier."""
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    odd = rows.groupBy("id").count().filter("id is null or id < 0 or id >= 2147483648 or count > 1")
    if not odd.isEmpty():
        raise ValueError("ids must be different whole numbers below 2^31")
    with scratch() as keep:
        held = materialize(_bucketed(rows.mapInArrow(thrifty(_grams(first)), "place long, gram binary"), "gram"), "buckets")
        for k in range(rounds):
            pointed = held.select((F.col("place") - first * 2**k).alias("place"), F.col("bucket").alias("pointer"))
            held = materialize(_bucketed(held.join(pointed, "place"), "bucket", "pointer"), "buckets")
        keep(held)
    again = held.filter("place <> bucket")
    return again.select(F.shiftright("place", 32).alias("id"), F.col("place").bitwiseAND((1 << 32) - 1).alias("start"))
