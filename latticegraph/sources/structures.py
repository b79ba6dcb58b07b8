"""Structures as keys and keys as structures: files and JSON of points."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crystal, elements, geometry
from ..operators import canonical
from . import cif

POINT = "struct<lnf: struct<coords: array<bigint>, xi: double>, mnf: struct<delta: int, elements: array<string>, coords: array<bigint>>>"
_KEYED = "structure_id string, key array<bigint>, labels array<int>, elements array<string>"


def keys_of(structures: DataFrame, xi: float, delta: int) -> DataFrame:
    """structure_id, key, labels and elements of structures as crystal files give them.

    A structure without atoms, or with a site that is not wholly occupied, raises ValueError.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                atoms = list(row["atoms"])
                if not atoms or any(abs(a["occupancy"] - 1) > 1e-6 for a in atoms):
                    raise ValueError(f"{row['structure_id']}: sites must be there and wholly occupied")
                atoms.sort(key=lambda a: -elements.NUMBER[a["element"]])
                names = [a["element"] for a in atoms]
                labels = [list(dict.fromkeys(names)).index(n) for n in names]
                key = crystal.real_key(cif.cell(row), [[a["x"], a["y"], a["z"]] for a in atoms], labels, xi, delta)
                out.append((row["structure_id"], list(key), labels, names))
            yield pd.DataFrame(out, columns=["structure_id", "key", "labels", "elements"])

    return canonical.spread(structures, "structure_id").mapInPandas(each, _KEYED)


def structure_of(key: Sequence[int], names: Sequence[str], xi: float, delta: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Cell, fractions and elements of a key."""
    return geometry.cell_from_vonorms(key[:7], xi), crystal.atoms_of(key) / delta, list(names)


def structures_of(keys: DataFrame, xi: float, delta: int) -> DataFrame:
    """Rows for crystal files of keys (structure_id, key, elements)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                cell, at, names = structure_of(r.key, r.elements, xi, delta)
                formula = " ".join(f"{n}{names.count(n)}" for n in dict.fromkeys(names))
                atoms = [{"element": n, "x": p[0], "y": p[1], "z": p[2], "occupancy": 1.0} for n, p in zip(names, at.tolist())]
                rows.append((r.structure_id, *geometry.cell_parameters(cell), formula, atoms))
            yield pd.DataFrame(rows, columns=["structure_id", "a", "b", "c", "alpha", "beta", "gamma", "formula", "atoms"])

    return keys.select("structure_id", "key", "elements").mapInPandas(each, cif.SCHEMA)


def to_json(keys: DataFrame, xi: float, delta: int) -> DataFrame:
    """keys (key, elements and any other columns) with a column point: the JSON of lattice form and motif form."""
    form = F.struct(
        F.struct(F.slice("key", 1, 7).alias("coords"), F.lit(float(xi)).alias("xi")).alias("lnf"),
        F.struct(F.lit(delta).alias("delta"), F.col("elements").alias("elements"), F.slice("key", F.lit(8), F.greatest(F.size("key") - 7, F.lit(0))).alias("coords")).alias("mnf"),
    )
    return keys.withColumn("point", F.to_json(form))


def from_json(texts: DataFrame) -> DataFrame:
    """texts (point and any other columns) with key, elements, xi and delta; text that is no point gives nulls."""
    rows = texts.withColumn("_p", F.from_json("point", POINT))
    return rows.select(*(c for c in texts.columns), F.concat("_p.lnf.coords", "_p.mnf.coords").alias("key"), F.col("_p.mnf.elements").alias("elements"), F.col("_p.lnf.xi").alias("xi"), F.col("_p.mnf.delta").alias("delta"))


def tuple_of(text: str) -> tuple[int, ...]:
    """A key from its JSON list."""
    return tuple(int(x) for x in json.loads(text))
