"""3 x 3 matrices, permutations and cells as column expressions; matrices are arrays of three rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lattice import determinant, dot


def product(a: Column, b: Column) -> Column:
    return F.array(*(F.array(*(sum((a[i][k] * b[k][j] for k in (1, 2)), a[i][0] * b[0][j]) for j in range(3))) for i in range(3)))


def transpose(m: Column) -> Column:
    return F.array(*(F.array(*(m[j][i] for j in range(3))) for i in range(3)))


def adjugate(m: Column) -> Column:
    """Times the matrix this is the determinant; for determinant one it is the inverse."""
    cofactor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    return F.array(*(F.array(*(cofactor(j, i) for j in range(3))) for i in range(3)))


def is_unimodular(m: Column) -> Column:
    return F.abs(determinant(m)) == 1


def apply(m: Column, v: Column) -> Column:
    return F.array(*(dot(m[i], v) for i in range(3)))


def permuted(v: Column, places: Column) -> Column:
    """Entry k is the one at places[k], counted from zero."""
    return F.transform(places, lambda p: F.element_at(v, p + 1))


def primary_set(places: Column) -> Column:
    """The places that the first four entries are taken from, sorted."""
    return F.sort_array(F.slice(places, 1, 4))


def cell_from_vonorms(v: Column) -> Column:
    """Lower triangular vectors with these vonorms; null where a vector has no length, rounding below zero is a flat cell."""
    a, b, c = v[0], v[1], v[2]
    ab, ac, bc = (v[4] - a - b) / 2, (v[5] - a - c) / 2, (v[6] - b - c) / 2
    zero = F.lit(0.0)
    x1 = F.sqrt(a)
    x2 = ab / x1
    y2 = F.sqrt(F.greatest(zero, b - x2 * x2))
    x3 = ac / x1
    y3 = F.when(y2 > 0, (bc - x2 * x3) / y2).otherwise(zero)
    z3 = F.sqrt(F.greatest(zero, c - x3 * x3 - y3 * y3))
    return F.when(F.least(a, b, c) > 0, F.array(F.array(x1, zero, zero), F.array(x2, y2, zero), F.array(x3, y3, z3)))


def delta_for(vectors: Column, step) -> Column:
    """Intervals of the longest edge that are at most step long."""
    longest = F.array_max(F.transform(vectors, lambda w: F.sqrt(dot(w, w))))
    return F.ceil(longest / step)


def atoms(coords: Column) -> Column:
    """Flat coordinates as an array of arrays of three."""
    return F.transform(F.sequence(F.lit(0), (F.size(coords) / 3).cast("int") - 1), lambda k: F.slice(coords, k * 3 + 1, F.lit(3)))


def wrapped(v: Column, delta) -> Column:
    return F.transform(v, lambda x: F.pmod(x, F.lit(delta)))


def shifted(points: Column, by: Column, delta) -> Column:
    """Points moved by a vector, and back into the cell."""
    return F.transform(points, lambda p: wrapped(F.zip_with(p, by, lambda x, y: x + y), delta))


def turned(points: Column, inverse: Column, delta) -> Column:
    """Points in the axes whose inverse matrix is given, back in the cell."""
    return F.transform(points, lambda p: wrapped(apply(inverse, p), delta))


def sorted_atoms(labels: Column, points: Column) -> Column:
    """Structs of label and point, sorted by label, then by coordinates."""
    return F.sort_array(F.zip_with(labels, points, lambda label, at: F.struct(label.alias("label"), at.alias("at"))))


def is_inversion_symmetric(labels: Column, points: Column, delta) -> Column:
    """Whether the motif and its mirror image through the origin are one up to the atom taken as origin."""
    back = lambda o: sorted_atoms(labels, shifted(F.transform(points, lambda p: F.transform(p, lambda x: -x)), o, delta))
    same = sorted_atoms(labels, F.transform(points, lambda p: wrapped(p, delta)))
    moves = F.transform(points, lambda p: F.zip_with(p, points[0], lambda x, y: x + y))
    return F.exists(moves, lambda o: back(o) == same)


def discretized(v: Column, xi) -> Column:
    """Nearest whole numbers of xi, halves to even; the sums of a superbasis may differ afterwards."""
    return F.transform(v, lambda x: F.rint(x / xi).cast("long"))


def discretized_coordinates(v: Column, delta) -> Column:
    return F.transform(v, lambda x: F.pmod(F.rint(x * delta).cast("long"), F.lit(delta)))


def weighted_manhattan(a: Column, b: Column) -> Column:
    """Twice the distance of two keys, in which the motif counts as much as the seven entries of the lattice."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size(a) - 7
    return (total(F.slice(gaps, 1, 7)) + F.when(n > 0, total(F.slice(gaps, F.lit(8), F.greatest(n, F.lit(1)))) * 7 / n).otherwise(0.0)) * 2


def about_equal(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether lists agree entry by entry, each within absolute plus relative times the second; other lengths never do."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.abs(y) * relative + absolute)
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)


def same_members(a: Column, b: Column) -> Column:
    """Whether lists hold the same entries in any order."""
    return F.array_sort(a) == F.array_sort(b)


def mended_vonorms(v: Column, xi) -> Column:
    """Whole numbers of xi nearest to real vonorms (halves to even), mended a unit at a time until the two sums agree.

    A unit goes to the entry at which it adds the least error, the first of equals. The error of a unit compares xi times
    the real value with the whole number, as stored keys do.
    """
    total = lambda w: w[0] + w[1] + w[2] + w[3] - w[4] - w[5] - w[6]

    def mend(w: Column, _: Column) -> Column:
        gap = F.signum(total(w)).cast("long")
        units = F.array(*(-gap if k < 4 else gap for k in range(7)))
        cost = F.array(*(F.round(F.abs((v[k] + units[k]) * xi - w[k]) - F.abs(v[k] * xi - w[k]), 5) for k in range(7)))
        at = F.array_position(cost, F.array_min(cost))
        return F.when(gap == 0, w).otherwise(F.transform(w, lambda x, k: F.when(k + 1 == at, x + F.element_at(units, k + 1)).otherwise(x)))

    first = discretized(v, xi)
    return F.aggregate(F.sequence(F.lit(0), F.abs(total(first))), first, mend)
