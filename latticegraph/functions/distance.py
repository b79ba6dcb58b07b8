"""Distances between integer keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def manhattan(a: Column, b: Column, scale: int = 2) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x) * scale


def squared_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def nearest_goal(key: Column, goals: Column, distance=manhattan) -> Column:
    """Smallest distance to any of an array of goal keys."""
    return F.array_min(F.transform(goals, lambda g: distance(key, g)))


def key_hash(key: Column) -> Column:
    """Placement aid only; equality always compares the key."""
    return F.xxhash64(key)


def parse_key(text: Column) -> Column:
    return F.from_json(text, "array<bigint>")


def key_text(key: Column) -> Column:
    return F.to_json(key)
