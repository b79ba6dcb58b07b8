"""Table functions for SQL: neighbours of keys.

register(spark) makes two names known: neighbours(key, labels, delta) for LATERAL joins, a row of neighbour for each key
that is one step away, and neighbours_of(TABLE(..)), which takes whole Arrow batches of a table with columns key, labels
and delta and gives (key, labels, delta, neighbour). A null in the input gives no rows. Spark allows no Arrow function in a
LATERAL join, so the first goes a row at a time; the second is the form for many keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..functions import crystal
from .canonical import _NEIGHBOUR_PART, _by_shape


def _found(key: pa.Array, labels: pa.Array, delta: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row of the input and neighbour, for rows that share labels and delta at a time."""
    keys, names, deltas = key.to_pylist(), labels.to_pylist(), delta.to_pylist()
    for d in {d for d in deltas if d is not None}:
        own = [k for k, x in enumerate(deltas) if x == d]
        for (label, _), places in _by_shape([names[k] for k in own], [keys[k] for k in own]).items():
            for at in range(0, len(places), _NEIGHBOUR_PART):
                part = np.array([own[k] for k in places[at : at + _NEIGHBOUR_PART]])
                row, near = crystal.neighbour_rows(np.array([keys[k] for k in part]), np.array(label), d)
                if len(row):
                    yield part[row], near


def _lists(near: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))


class Neighbours:
    """neighbours(key, labels, delta) -> neighbour."""

    def eval(self, key: list[int] | None, labels: list[int] | None, delta: int | None) -> Iterator[tuple[list[int]]]:
        if key and labels and delta and None not in key and None not in labels:
            for near in crystal.neighbours(key, labels, delta):
                yield (list(near),)


class NeighboursOf:
    """neighbours_of(TABLE(key, labels, delta)) -> key, labels, delta, neighbour."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        key, labels, delta = (batch.column(c) for c in ("key", "labels", "delta"))
        for row, near in _found(key, labels, delta):
            at = pa.array(row)
            yield pa.table({"key": key.take(at), "labels": labels.take(at), "delta": delta.take(at), "neighbour": _lists(near)})


def register(spark: SparkSession) -> None:
    spark.udtf.register("neighbours", udtf(Neighbours, returnType="neighbour array<bigint>", useArrow=False))
    spark.udtf.register("neighbours_of", arrow_udtf(NeighboursOf, returnType="key array<bigint>, labels array<int>, delta int, neighbour array<bigint>"))
