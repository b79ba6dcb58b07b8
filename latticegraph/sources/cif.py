"""Crystal files in the P1 setting: one row per file and one array of atoms."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry

ATOM = "struct<element: string, x: double, y: double, z: double, occupancy: double>"
SCHEMA = f"structure_id string, a double, b double, c double, alpha double, beta double, gamma double, formula string, atoms array<{ATOM}>"
_LENGTHS = ["_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_angle_alpha", "_cell_angle_beta", "_cell_angle_gamma"]


def _number(text: str) -> float:
    """A number without the uncertainty in brackets."""
    return float(text.split("(")[0])


def _tokens(line: str) -> list[str]:
    return [a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", line)]


def parse(text: str) -> dict:
    """Cell, formula and atoms of the first data block; a site without all of element and coordinates raises ValueError."""
    tags, atoms, columns, in_loop = {}, [], [], False
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith("loop_"):
            columns, in_loop = [], True
        elif line.startswith("_"):
            name, *value = _tokens(line)
            if in_loop and not value:
                columns.append(name)
            else:
                in_loop = False
                tags[name] = value[0] if value else ""
        elif in_loop and "_atom_site_fract_x" in columns:
            row = dict(zip(columns, _tokens(line)))
            symbol = row.get("_atom_site_type_symbol") or row.get("_atom_site_label", "")
            element = re.match(r"[A-Z][a-z]?", symbol)
            if element is None:
                raise ValueError(f"a site has no element: {line!r}")
            at = [_number(row[f"_atom_site_fract_{k}"]) for k in "xyz"]
            atoms.append((element[0], *at, _number(row.get("_atom_site_occupancy", "1"))))
    if missing := [t for t in _LENGTHS if t not in tags]:
        raise ValueError(f"tags are missing: {missing}")
    return dict(zip("a b c alpha beta gamma".split(), (_number(tags[t]) for t in _LENGTHS))) | {"formula": tags.get("_chemical_formula_sum"), "atoms": atoms}


def parse_texts(texts: DataFrame) -> DataFrame:
    """Structures of rows (structure_id, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["element", "x", "y", "z", "occupancy"]
        for batch in batches:
            rows = [{"structure_id": i, **parse(t)} for i, t in zip(batch["structure_id"], batch["text"])]
            for r in rows:
                r["atoms"] = [dict(zip(names, a)) for a in r["atoms"]]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", atoms")[0].split(", ")] + ["atoms"])

    return texts.select("structure_id", "text").mapInPandas(each, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Structures of all files under a path or glob; the file's stem is the id."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.cif)?$", 1).alias("structure_id"), F.col("value").alias("text"))
    return parse_texts(files)


def text(structures: DataFrame) -> DataFrame:
    """structure_id and text of structures, by expressions alone."""
    line = lambda tag, col: F.concat(F.lit(f"{tag} "), F.format_string("%.8f", col))
    sites = F.transform("atoms", lambda a: F.concat_ws(" ", a["element"], *(F.format_string("%.8f", a[k]) for k in "xyz"), F.format_string("%.4f", a["occupancy"])))
    head = [F.concat(F.lit("data_"), "structure_id"), F.lit("_symmetry_space_group_name_H-M 'P 1'")]
    head += [line(t, F.col(c)) for t, c in zip(_LENGTHS, "a b c alpha beta gamma".split())]
    head += [F.concat(F.lit("_chemical_formula_sum '"), F.coalesce("formula", F.lit("")), F.lit("'"))]
    loop = ["loop_", "_atom_site_type_symbol", *(f"_atom_site_fract_{k}" for k in "xyz"), "_atom_site_occupancy"]
    return structures.select("structure_id", F.concat_ws("\n", *head, *map(F.lit, loop), F.array_join(sites, "\n")).alias("text"))


def text_of(row: dict) -> str:
    """Text of one structure, as text() makes it."""
    head = [f"data_{row['structure_id']}", "_symmetry_space_group_name_H-M 'P 1'"]
    head += [f"{tag} {row[c]:.8f}" for tag, c in zip(_LENGTHS, "a b c alpha beta gamma".split())]
    head += [f"_chemical_formula_sum '{row['formula'] or ''}'", "loop_", "_atom_site_type_symbol", *(f"_atom_site_fract_{k}" for k in "xyz"), "_atom_site_occupancy"]
    sites = [" ".join([a["element"], *(f"{a[k]:.8f}" for k in "xyz"), f"{a['occupancy']:.4f}"]) for a in row["atoms"]]
    return "\n".join([*head, *sites])


def write(structures: DataFrame, path: str) -> None:
    """One file per structure, named by its id, in a partition folder each."""
    text(structures).write.partitionBy("structure_id").text(os.path.join(path, ""))


def cell(row) -> np.ndarray:
    return geometry.cell_from_parameters(row["a"], row["b"], row["c"], row["alpha"], row["beta"], row["gamma"])
