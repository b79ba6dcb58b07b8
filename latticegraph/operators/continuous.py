"""Crystals in continuous space as operators over rows: relaxation of atoms and cell, elastic bands, aligned paths.

Structures are rows of id, cell (three vectors), fractions (flat) and labels; paths are rows of path, keys, labels, xi and
delta. Structures of one atom count go through the minimiser together, equal structures and equal paths once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, crystal, forces, geometry
from ..functions.calculators import PairCalculator, Provider
from .canonical import once

RELAXED = "id bigint, cell array<array<double>>, fractions array<double>, labels array<int>, energy_before double, energy double, force double, volume double, steps int"
ALIGNED = "path bigint, step int, cell array<array<double>>, fractions array<double>, left double"
BAND = "path bigint, image int, cell array<array<double>>, fractions array<double>, energy double, force double, steps int, settled boolean"

#: What a path is computed from; paths that share it are computed once.
_PATH = ["keys", "labels", "xi", "delta"]


def _of_problem(schema: str) -> str:
    """A schema with the column problem in place of the first."""
    return "problem string, " + schema.split(", ", 1)[1]


#: Structures that the minimiser takes at once.
_PART = 256

#: Bands that settle at once.
_BANDS = 64


def _vectors(cells: np.ndarray) -> pa.Array:
    """Cells (b, 3, 3) as a column of arrays of arrays."""
    b = len(cells)
    rows = pa.ListArray.from_arrays(np.arange(3 * b + 1, dtype=np.int32) * 3, pa.array(cells.ravel()))
    return pa.ListArray.from_arrays(np.arange(b + 1, dtype=np.int32) * 3, rows)


def _flat(values: np.ndarray) -> pa.Array:
    values = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def relax_cells(structures: DataFrame, *, force: float = 0.01, max_steps: int = 500, provider: Provider = PairCalculator) -> DataFrame:
    """RELAXED: every structure at the end of its minimisation, its energies before and after and the largest force left.

    Structures with a null or without atoms are left out; others keep their labels in their order.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calculator = provider()
        for batch in batches:
            sizes = batch.column("labels").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                places = np.flatnonzero(sizes == n)
                for at in range(0, len(places), _PART):
                    part = batch.take(pa.array(places[at : at + _PART]))
                    cells = part.column("cell").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
                    fractions = part.column("fractions").flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1, 3)
                    before = calculator.gradients(cells, fractions)[0]
                    cells, fractions, energies, left, steps = forces.relax_cells(calculator, cells, fractions, force=force, max_steps=max_steps)
                    volumes = np.abs(np.linalg.det(cells))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("problem"), _vectors(cells), _flat(fractions), part.column("labels"), *map(pa.array, (before, energies, left, volumes)), pa.array(steps.astype(np.int32))],
                        ["problem", "cell", "fractions", "labels", "energy_before", "energy", "force", "volume", "steps"],
                    )

    rows = structures.filter("id is not null and cell is not null and size(labels) > 0 and size(fractions) = 3 * size(labels)")
    rows = rows.select(F.col("id").cast("long"), F.col("cell").cast("array<array<double>>"), F.col("fractions").cast("array<double>"), F.col("labels").cast("array<int>"))
    return once(rows, each, _of_problem(RELAXED), ["cell", "fractions", "labels"], ["id"], arrow=True)


def _crystals(keys, xi: float, delta: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [geometry.cell_from_vonorms(k[:7], xi) for k in keys], [crystal.atoms_of(k) / delta for k in keys]


def aligned_paths(paths: DataFrame) -> DataFrame:
    """ALIGNED: the crystals of every path, each in the axes and the order of atoms nearest to the one before it, and the
    distance left to that one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cells, fractions, left = geometry.align_path(*_crystals(r["keys"], r["xi"], r["delta"]), r["labels"])
                n = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array([r["problem"]] * n, pa.string()), pa.array(range(n), pa.int32()), _vectors(np.array(cells)), _flat(np.array(fractions)), pa.array(left, pa.float64())], ["problem", "step", "cell", "fractions", "left"])

    return once(_whole(paths), each, _of_problem(ALIGNED), _PATH, ["path"], arrow=True)


def _whole(paths: DataFrame) -> DataFrame:
    rows = paths.filter("path is not null and size(keys) > 0 and labels is not null").select("path", "keys", F.col("labels").cast("array<int>"), F.col("xi").cast("double"), F.col("delta").cast("int"))
    return rows


def elastic_bands(paths: DataFrame, *, images: int = 7, spring: float = 5.0, climbing: bool = True, force: float = 0.05, max_steps: int = 200, provider: Provider = PairCalculator) -> DataFrame:
    """BAND: so many images of a band between the ends of every path, settled from the aligned path resampled by distance.

    The barrier of a path is the highest energy of its images less that of the first. A path of one key is left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calculator = provider()
        for batch in batches:
            alike: dict[int, list] = {}  # bands of one atom count settle together
            for r in batch.to_pylist():
                cells, fractions, _ = geometry.align_path(*_crystals(r["keys"], r["xi"], r["delta"]), r["labels"])
                chain = list(zip(cells, fractions))
                space = bands.CrystalSpace(calculator, (chain[0], chain[-1]))
                alike.setdefault(len(r["labels"]), []).append((r["problem"], space, bands.resampled(space, chain, images)))
            for rows in alike.values():
                for at in range(0, len(rows), _BANDS):
                    problems, spaces, starts = zip(*rows[at : at + _BANDS])
                    settled = bands.settle_all(spaces, starts, spring=spring, climbing=climbing, force=force, max_steps=max_steps)
                    for problem, (band, energies, left, steps) in zip(problems, settled):
                        n = len(band)
                        made = [pa.array([problem] * n, pa.string()), pa.array(range(n), pa.int32()), _vectors(np.array([c for c, _ in band])), _flat(np.array([f for _, f in band])), pa.array(energies)]
                        yield pa.RecordBatch.from_arrays([*made, pa.array([left] * n, pa.float64()), pa.array([steps] * n, pa.int32()), pa.array([left <= force] * n)], ["problem", "image", "cell", "fractions", "energy", "force", "steps", "settled"])

    return once(_whole(paths).filter("size(keys) > 1"), each, _of_problem(BAND), _PATH, ["path"], arrow=True)


def barriers(band: DataFrame) -> DataFrame:
    """path, barrier, the image at the top, images and whether the band settled."""
    first = F.min_by("energy", "image")
    return band.groupBy("path").agg((F.max("energy") - first).alias("barrier"), F.max_by("image", F.struct("energy", -F.col("image"))).alias("top"), F.count("*").alias("images"), F.bool_and("settled").alias("settled"))
