"""The flooding mailbox as a stream: letters with keys arrive, each key is taken once, and windows count arrivals.

take_once() keeps, for every key, the letter that it was taken with. A letter of a key that was taken is dropped; a key
that got no letter for KEEP is forgotten by a timeout, so state stays bounded by the keys of that time. deliver() runs the
stream into a folder: a micro-batch is written to a folder of its number, replacing what a lost run of the same batch
left, so letters arrive at least once at the sink and stand in it exactly once after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Time after its last letter for which a key is remembered, in milliseconds of processing time.
KEEP = 7 * 24 * 3600 * 1000


def first_arrivals(inbox: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; works on a stream and on a batch."""
    marked = inbox.withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark([key]) if inbox.isStreaming else inbox.dropDuplicates([key])


def arrivals_per_window(inbox: DataFrame, time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Start of each tumbling window and its number of arrivals."""
    counted = inbox.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).count()
    return counted.select(F.col("w.start").alias("start"), F.col("count").alias("n"))


def take_once(inbox: DataFrame, key: str, letter: str, keep: int = KEEP) -> DataFrame:
    """key and letter of a stream of letters (whole numbers): the smallest letter of the first batch that has the key.

    The state of a key is the letter it was taken with; every batch with a letter sets its timeout anew. Letters without
    key or number are dropped.
    """
    rows = inbox.select(F.col(key).alias("key"), F.col(letter).cast("long").alias("letter")).filter("key is not null and letter is not null")
    kind = rows.schema["key"].dataType.simpleString()

    def each(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = min(int(part["letter"].min()) for part in parts)
        if not state.exists:
            state.update((first,))
            yield pd.DataFrame({"key": [name[0]], "letter": [first]})
        state.setTimeoutDuration(keep)

    return rows.groupBy("key").applyInPandasWithState(each, f"key {kind}, letter bigint", "taken bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def deliver(inbox: DataFrame, key: str, letter: str, folder: str, keep: int = KEEP) -> DataFrame:
    """Takes all letters that are there now and returns what was taken so far; a call with the same folder goes on.

    The folder holds the stream's checkpoint and a folder of what every batch took.
    """
    taken = take_once(inbox, key, letter, keep)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/taken/batch={number}")

    spark, name = inbox.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    # timeouts ask for batches without data for ever; a stream that ends with its letters looks at them with the next letters
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        query = taken.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(taken.schema).parquet(f"{folder}/taken").select("key", "letter")
