"""Motifs that are equal but for a shift and small displacements of their atoms, found by geometric hashing.

A motif is a row of id, labels and coords (flat fractions of a cell). Two motifs match if they have the same labels and an
atom of the anchor label (the rarest, of several the smallest) of each can be laid on one another so that all other atoms
pair off by label with every coordinate at most tolerance apart, whole cells not counted.

Motifs that are equal up to a shift are first brought together as classes, so copies cost nothing. Of every class one
difference vector, from its first anchor to one other atom, is filed under its cell of a grid twice as coarse as the
tolerance and the cells around it; the difference vectors from all anchors to all atoms of that label are filed under
their own cell alone. Matching motifs share a cell, for aligning an anchor moves a difference by at most two tolerances.
The pairs of an equi-join over labels and cells are then held against the definition.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..storage import written
from .canonical import spread

#: Fractions that a cell is divided into where motifs are compared exactly.
FINE = 1_000_000


def _parts(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and those of the atoms that a difference leads to; none for one atom."""
    names, counts = np.unique(labels, return_counts=True)
    order = [name for _, name in sorted(zip(counts, names))]
    anchors = np.flatnonzero(labels == order[0])
    others = next((o for o in (np.flatnonzero(labels == name) for name in order) if len(o) > (o[0] == anchors[0])), anchors[:0])
    return anchors, others


def _form(labels: np.ndarray, at: np.ndarray) -> list[int]:
    """The same numbers for all shifts and orders of a motif, in FINE-ths."""
    best = None
    for o in _parts(labels)[0]:
        x = np.mod(np.rint((at - at[o]) * FINE).astype(np.int64), FINE)
        rows = sorted(zip(labels.tolist(), *x.T.tolist()))
        best = rows if best is None or rows < best else best
    return list(itertools.chain.from_iterable(best))


def _matches(labels: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float) -> bool:
    """Whether two motifs with the same sorted labels match."""
    anchors = _parts(labels)[0]
    apart = labels[:, None] != labels[None]
    for o, p in itertools.product(anchors, anchors):
        d = (a - a[o])[:, None] - (b - b[p])[None]
        far = (np.abs(d - np.rint(d)) > tolerance + 1e-9).any(2) | apart
        far[o, np.arange(len(b)) != p] = far[np.arange(len(a)) != o, p] = True
        if not far[o, p] and not far[np.arange(len(a)), geometry.assign(far.astype(float))].any():
            return True
    return False


def motif_classes(motifs: DataFrame) -> DataFrame:
    """id and class (the smallest id) of motifs that are equal up to a shift; rows with a null or without atoms have none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = []
            for labels, coords in zip(batch.column("labels").to_pylist(), batch.column("coords").to_pylist()):
                fit = labels and coords and None not in labels and None not in coords and len(coords) == 3 * len(labels)
                forms.append(_form(np.array(labels), np.array(coords).reshape(-1, 3)) if fit else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "labels", "coords")), pa.array(forms, pa.list_(pa.int64()))], ["id", "labels", "coords", "form"])

    rows = motifs.select(F.col("id").cast("long"), F.col("labels").cast("array<int>"), F.col("coords").cast("array<double>"))
    alone = spread(rows.groupBy("labels", "coords").agg(F.min("id").alias("id")), "labels", "coords")  # equal rows go once
    forms = alone.mapInArrow(each, "id bigint, labels array<int>, coords array<double>, form array<bigint>").filter("form is not null")
    forms = forms.join(forms.groupBy("form").agg(F.min("id").alias("class")), "form")
    return rows.join(forms.select("labels", "coords", "class"), ["labels", "coords"]).filter("id is not null").select("id", "class")


def _filed(tolerance: float, probe: bool):
    """Grid cells of difference vectors: of one with the cells around it (probe), or of all."""
    cells = max(1, int(1 / (2 * tolerance)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
        for batch in batches:
            row, cell = [], []
            for k, (labels, coords) in enumerate(zip(batch.column("labels").to_pylist(), batch.column("coords").to_pylist())):
                labels, at = np.array(labels), np.array(coords).reshape(-1, 3)
                anchors, others = _parts(labels)
                pairs = [(o, j) for o in anchors for j in others if o != j]
                d = np.array([at[j] - at[o] for o, j in (pairs[:1] if probe else pairs)]).reshape(-1, 3) % 1
                grid = np.floor(d * cells).astype(int) % cells
                if probe:
                    grid = (grid[:, None] + around).reshape(-1, 3) % cells
                found = np.unique((grid[:, 0] * cells + grid[:, 1]) * cells + grid[:, 2])
                row += [k] * len(found)
                cell += found.tolist()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("id", "labels")] + [pa.array(cell, pa.int64())], ["id", "labels", "cell"])

    return each


def motif_matches(motifs: DataFrame, tolerance: float) -> DataFrame:
    """a and b, a below b, of all classes of motifs that match within a tolerance but are not equal."""
    rows = motifs.select(F.col("id").cast("long"), F.col("labels").cast("array<int>"), F.col("coords").cast("array<double>"))
    rows = written(rows.groupBy("labels", "coords").agg(F.min("id").alias("id")), "motifs")
    heads = motif_classes(rows).filter("id = class").select("id")
    rows = rows.join(heads, "id").select("id", *(F.col(c) for c in ("labels", "coords")))
    # atoms in the order of their labels, so that equal compositions have equal arrays
    order = F.array_sort(F.transform("labels", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("o", order)
    rows = rows.select("id", F.transform("o", lambda s: s["x"]).alias("labels"), F.flatten(F.transform("o", lambda s: F.slice("coords", s["i"] * 3 + 1, 3))).alias("coords"))
    rows = written(rows, "heads")
    kind = "id bigint, labels array<int>, cell bigint"
    probes = rows.mapInArrow(_filed(tolerance, True), kind)
    entries = rows.mapInArrow(_filed(tolerance, False), kind)
    pairs = probes.alias("p").join(entries.alias("e"), ["labels", "cell"]).filter("p.id <> e.id")
    pairs = pairs.select(F.least("p.id", "e.id").alias("a"), F.greatest("p.id", "e.id").alias("b")).distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), "labels", F.col("coords").alias("first")), "a").join(rows.select(F.col("id").alias("b"), F.col("coords").alias("second")), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_matches(np.array(r["labels"]), np.array(r["first"]).reshape(-1, 3), np.array(r["second"]).reshape(-1, 3), tolerance) for r in batch.to_pylist()]
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return spread(both.select("a", "b", "labels", "first", "second"), "a", "b").mapInArrow(each, "a bigint, b bigint")
