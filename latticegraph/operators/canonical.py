"""Canonical keys and their neighbours as operators over rows of crystals.

Crystals are rows of id, v (seven vonorms), labels and coords (three integers for every atom). Keys are rows of id, key
and labels. Keys and neighbours are found for many rows of an Arrow batch at once, in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crystal, forces, geometry, pathfinding
from ..functions.calculators import PairCalculator, Provider
from ..storage import scratch, written
from .search import appended, united
from .supersteps import Listener, Progress, observed, tell

KEYS = "id bigint, key array<bigint>, labels array<int>"
PAIRS = "key array<bigint>, labels array<int>, neighbour array<bigint>"


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by columns into as many partitions as a shuffle has.

    The number is given, so that adaptive execution does not join partitions: the work of a row here is far more than
    its bytes tell. A hash stands for the columns, because Spark drops a repartition by columns that rows are already
    shuffled by (after distinct), and then joins those partitions after all.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def once(rows: DataFrame, each, schema: str, asked: list[str], kept: list[str], arrow: bool = False, near: str | None = None) -> DataFrame:
    """The columns kept of rows, with what a function of batches makes of the columns asked, run once for equal ones.

    The function gets and gives back a column problem, which stands for the columns asked. Rows that agree in the column
    near, one of those asked, follow each other in a task, _NEAR of them at most, so that they can share what they find.
    """
    rows = rows.withColumn("problem", F.sha2(F.to_json(F.struct(*asked)), 256))
    alone = rows.select("problem", *asked).dropDuplicates(["problem"])
    if near:
        place = F.row_number().over(Window.partitionBy(near).orderBy("problem")) - 1
        alone = alone.withColumn("share", F.floor(place / _NEAR))
        alone = spread(alone, near, "share").sortWithinPartitions(near, "share").drop("share")
    else:
        alone = spread(alone, "problem")
    made = (alone.mapInArrow if arrow else alone.mapInPandas)(each, schema)
    return rows.select("problem", *kept).join(made, "problem").drop("problem")


#: Rows of one kind that share what they find.
_NEAR = 64
#: Rows whose keys or neighbours are found at once.
_PART = 2048
_NEIGHBOUR_PART = 64


def _by_shape(lists: list, *more: list) -> dict[tuple, list[int]]:
    """Places of rows with the same labels and lengths; rows with a null, or a null inside, are left out."""
    out: dict[tuple, list[int]] = {}
    for k, row in enumerate(zip(lists, *more)):
        if all(x is not None and None not in x for x in row):
            out.setdefault((tuple(row[0]), *map(len, row[1:])), []).append(k)
    return out


def canonical_keys(crystals: DataFrame, delta: int) -> DataFrame:
    """id, key and labels of crystals; a crystal without atoms, or with a null, has a null key.

    The crystals of a batch that share their labels go through reduction, orientations and minima together.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, labels, coords = (batch.column(k).to_pylist() for k in (1, 2, 3))
            keys: list = [None] * batch.num_rows
            for (own, w, n), places in _by_shape(labels, v, coords).items():
                if not own or w != 7 or n != 3 * len(own):
                    continue
                for at in range(0, len(places), _PART):
                    part = places[at : at + _PART]
                    found = crystal.canonical_keys(np.array([v[k] for k in part]), np.array([coords[k] for k in part]).reshape(len(part), -1, 3), np.array(own), delta)
                    for k, key in zip(part, found.tolist()):
                        keys[k] = key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), batch.column(2)], ["id", "key", "labels"])

    return crystals.select(F.col("id").cast("long"), "v", F.col("labels").cast("array<int>"), "coords").mapInArrow(each, KEYS)


def neighbour_keys(keys: DataFrame, delta: int, kind: str = "all") -> DataFrame:
    """Distinct (key, labels, neighbour) of distinct keys; kind is lattice, motif or all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, labels = (batch.column(k).to_pylist() for k in (0, 1))
            for (own, _), places in _by_shape(labels, key).items():
                for at in range(0, len(places), _NEIGHBOUR_PART):
                    part = np.array(places[at : at + _NEIGHBOUR_PART])
                    row, near = crystal.neighbour_rows(np.array([key[k] for k in part]), np.array(own), delta, kind)
                    if len(row):
                        index = pa.array(part[row])
                        offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * near.shape[1])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))], ["key", "labels", "neighbour"])

    rows = keys.filter("key is not null").select("key", F.col("labels").cast("array<int>")).distinct()
    return spread(rows, "key").mapInArrow(each, PAIRS)


def geometry_of(keys: DataFrame, xi: float, delta: int, k: int = 20) -> DataFrame:
    """key, volume, shortest bond (null for one atom), pair energy and average minimum distances of distinct keys.

    Keys of one atom count go through the neighbour search together.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("key").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                for at in range(0, len(places), _PART):
                    part = batch.column("key").take(pa.array(places[at : at + _PART]))
                    rows = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
                    cells = np.array([geometry.cell_from_vonorms(v, xi) for v in rows[:, :7]])
                    fractions = np.concatenate([np.zeros((len(rows), 1, 3)), rows[:, 7:].reshape(len(rows), -1, 3)], 1) / delta
                    near = forces.near_distances(cells, fractions, max(k, 12))
                    bonds = np.array([geometry.shortest_bond(c, f) for c, f in zip(cells, fractions)]) if size > 7 else np.full(len(rows), np.inf)
                    q = (3.0 / np.maximum(near[:, :, :12], 1.5)) ** 3
                    made = [part, pa.array(np.abs(np.linalg.det(cells))), pa.array(bonds, mask=~np.isfinite(bonds)), pa.array((q * q - 2 * q).sum((1, 2)) / 2), pa.array(near[:, :, :k].mean(1).tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(made, ["key", "volume", "bond", "energy", "amd"])

    return spread(keys.filter("key is not null").select("key").distinct(), "key").mapInArrow(each, "key array<bigint>, volume double, bond double, energy double, amd array<double>")


def relax(keys: DataFrame, xi: float, delta: int, max_steps: int = 1000, provider: Provider = PairCalculator) -> DataFrame:
    """key, labels, the path of falling energy from it and the energy at its end, for distinct keys."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calculator = provider()
        for batch in batches:
            for key, labels in zip(batch["key"], batch["labels"]):
                energies = pathfinding.Energies(xi, delta, calculator.energy)
                path = pathfinding.descend(tuple(key), labels, delta, energies, max_steps)
                yield pd.DataFrame({"key": [key], "labels": [labels], "path": [[list(k) for k in path]], "energy": [energies(path[-1])]})

    return spread(keys.filter("key is not null").select("key", "labels").distinct(), "key").mapInPandas(each, "key array<bigint>, labels array<int>, path array<array<bigint>>, energy double")


def endpoint_keys(structures: DataFrame, xi: float, delta: int) -> DataFrame:
    """Distinct keys of all supercells of structures (id, cell, fractions, labels, index), labels sorted.

    cell is three vectors and fractions a flat array. A structure gives one row per supercell form.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[tuple, list] = {}  # supercells of one list of labels, which go through the forms together
            for r in batch.to_pylist():
                cell, at = np.array(r["cell"]), np.array(r["fractions"]).reshape(-1, 3)
                for matrix in crystal.hermite_matrices(int(r["index"])):
                    big, places, labels = crystal.supercell(cell, at, np.asarray(r["labels"]), matrix)
                    made.setdefault(tuple(labels.tolist()), []).append((r["id"], big, places))
            for labels, rows in made.items():
                for k in range(0, len(rows), _PART):
                    ids, cells, places = zip(*rows[k : k + _PART])
                    keys = crystal.real_keys(np.array(cells), np.array(places), labels, xi, delta)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array([labels] * len(ids), pa.list_(pa.int32()))], ["id", "key", "labels"])

    rows = structures.select(F.col("id").cast("long"), "cell", "fractions", F.col("labels").cast("array<int>"), "index")
    return spread(rows, "id").mapInArrow(each, KEYS).distinct()


def energies_of(keys: DataFrame, xi: float, delta: int, provider: Provider = PairCalculator) -> DataFrame:
    """key and energy of distinct keys; each task has a calculator of its own, which gets a batch at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calculator = provider()
        for batch in batches:
            structures = [(geometry.cell_from_vonorms(k[:7], xi), crystal.atoms_of(k) / delta) for k in map(tuple, batch["key"])]
            yield pd.DataFrame({"key": batch["key"], "energy": calculator.energies(structures)})

    return spread(keys.select("key").distinct(), "key").mapInPandas(each, "key array<bigint>, energy double")


def resolution_rows(structures: DataFrame, k: int = 20) -> DataFrame:
    """id, xi, delta, number of neighbours of the key and distance to the crystal rebuilt from it.

    structures has id, cell (three vectors), fractions (flat), labels (sorted) and the resolution (xi, delta).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple, list] = {}  # structures of one list of labels and one resolution
            for r in batch.to_pylist():
                alike.setdefault((tuple(r["labels"]), r["xi"], int(r["delta"])), []).append(r)
            for (labels, xi, delta), rows in alike.items():
                for at in range(0, len(rows), _NEIGHBOUR_PART):
                    part = rows[at : at + _NEIGHBOUR_PART]
                    cells, fractions = np.array([r["cell"] for r in part]), np.array([r["fractions"] for r in part]).reshape(len(part), -1, 3)
                    keys = crystal.real_keys(cells, fractions, labels, xi, delta)
                    n = np.bincount(crystal.neighbour_rows(keys, np.array(labels), delta)[0], minlength=len(part))
                    again = np.concatenate([np.zeros((len(part), 1, 3)), keys[:, 7:].reshape(len(part), -1, 3)], 1) / delta
                    before = forces.near_distances(cells, fractions, k)
                    after = forces.near_distances(np.array([geometry.cell_from_vonorms(v, xi) for v in keys[:, :7]]), again, k)
                    apart = [geometry.pdd_distance(a, b) for a, b in zip(before, after)]
                    m = len(part)
                    made = [pa.array([r["id"] for r in part], pa.int64()), pa.array([xi] * m), pa.array([delta] * m, pa.int32()), pa.array(n, pa.int32()), pa.array(apart, pa.float64())]
                    yield pa.RecordBatch.from_arrays(made, ["id", "xi", "delta", "neighbours", "pdd"])

    rows = spread(structures.select("id", "cell", "fractions", "labels", "xi", "delta"), "id", "xi", "delta")
    return rows.mapInArrow(each, "id bigint, xi double, delta int, neighbours int, pdd double")


def flood_keys(
    start: DataFrame, goals: DataFrame, xi: float, delta: int, *, width: float = 0.0, batch: int = 1000, max_steps: int = 50, provider: Provider = PairCalculator, folder: str | None = None, listener: Listener | None = None
) -> DataFrame:
    """key, labels, parent, energy and step of the points flooded from start (key, labels), over computed neighbours.

    Each list of labels is a flood of its own; all go through a step together. A step explores the open points at most
    width above the lowest open energy of their labels, batch of them at most, lowest first. Energies are computed for
    points not seen before alone. A flood ends when a goal (key) is seen or nothing is open, all end after max_steps steps.
    No start gives no rows. folder keeps progress, so that a run that was lost goes on; a listener is told the new and the
    open points, the floods and the lowest level of every step.
    """
    spark = start.sparkSession
    first = start.select("key", "labels").distinct()
    wanted = goals.select("key").distinct()
    columns = ["key", "labels", F.lit(None).cast("array<bigint>").alias("parent"), "energy", F.lit(0).alias("step")]
    progress = Progress(spark, folder, (xi, delta, width, batch))
    progress.recover()
    with scratch() as keep:
        hold = keep if folder else lambda df: df
        if (kept := progress.load()) is None:
            fresh = front = hold(written(first.join(energies_of(first, xi, delta, provider), "key").select(*columns), "flood"))
            seen, step = [fresh], 0
        else:
            step, tables, _ = kept
            seen, front = tables["seen"], tables["front"][0]
        while step < max_steps:
            step += 1
            reached = united(seen).join(wanted, "key", "left_semi").select("labels").distinct()
            open_now = front.join(reached, "labels", "left_anti")
            levels = open_now.groupBy("labels").agg(F.min("energy").alias("level"), F.count("*").alias("n"))
            levels, plan = observed(levels, "levels", floods=F.count(F.lit(1)), level=F.min("level"), open=F.coalesce(F.sum("n"), F.lit(0)))
            if not plan["floods"]:
                break
            near = open_now.join(levels, "labels").filter(F.col("energy") <= F.col("level") + width)
            lowest = Window.partitionBy("labels").orderBy("energy", "key")
            now = written(near.withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= batch).select("key", "labels"), "now")
            arrived = neighbour_keys(now, delta).groupBy(F.col("neighbour"), "labels").agg(F.min("key").alias("parent")).withColumnRenamed("neighbour", "key")
            entered = written(arrived.join(united(seen).select("key", "labels"), ["key", "labels"], "left_anti"), "entered")
            fresh, new = observed(entered.join(energies_of(entered, xi, delta, provider), "key").select("key", "labels", "parent", "energy", F.lit(step).alias("step")), "flood", new=F.count(F.lit(1)))
            front = written(front.join(now, ["key", "labels"], "left_anti").select("key", "labels", "energy").unionByName(fresh.select("key", "labels", "energy")), "front")
            seen = appended(seen, fresh)
            progress.save(step, {"seen": [hold(p) for p in seen], "front": [hold(front)]}, {**plan, **new})
            tell(listener, step, {**plan, **new})
        return united([keep(p) for p in seen]).select("key", "labels", "parent", "energy", "step")
