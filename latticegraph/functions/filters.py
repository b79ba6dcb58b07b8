"""Conditions a point must pass, as boolean columns; a point for which one is null does not pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column) -> Column:
    """All conditions in the order given; without any, every point passes."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(True))


def volume_between(volume: Column, low, high) -> Column:
    """Both bounds are exclusive."""
    return (volume > low) & (volume < high)


def distances_above(distances: Column, limit) -> Column:
    """Every distance is above the limit; a point without distances passes."""
    return F.forall(distances, lambda x: x > limit)


def energy_below(energy: Column, ceiling) -> Column:
    return energy < ceiling


def in_ellipsoid(to_start: Column, to_goal: Column, apart, tolerance: float = 1.2) -> Column:
    """The distances to the nearest start and goal add up to at most tolerance times how far those are apart."""
    return to_start + to_goal <= apart * tolerance


#: How far beyond the ends of a search a point may go, as shares of volume and bond, and in energy an atom.
LEAST_VOLUME, MOST_VOLUME, LEAST_BOND, ENERGY_ROOM = 0.8, 1.2, 0.75, 3.0


def limits_of_ends(ends: DataFrame, *by: str) -> DataFrame:
    """Bounds that the ends of a search imply: low and high volume, least distance and energy ceiling, a row for each by.

    ends has volume, bond (shortest distance, null for one atom), energy and n_atoms. The ceiling is that of the highest
    energy an atom with room, times the atoms. Without a bond the least distance is null.
    """
    per_atom = F.col("energy") / F.col("n_atoms")
    return ends.groupBy(*by).agg(
        (F.min("volume") * LEAST_VOLUME).alias("low"), (F.max("volume") * MOST_VOLUME).alias("high"),
        (F.min("bond") * LEAST_BOND).alias("least"), ((F.max(per_atom) + ENERGY_ROOM) * F.max("n_atoms")).alias("ceiling"),
    )


def within_limits(volume: Column, bond: Column, energy: Column) -> Column:
    """Whether a point passes the columns low, high, least and ceiling; one without a bond, or ends without, has no least."""
    far = F.col("least").isNull() | bond.isNull() | (bond > F.col("least"))
    return all_of(volume_between(volume, F.col("low"), F.col("high")), far, energy_below(energy, F.col("ceiling")))
