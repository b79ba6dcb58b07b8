"""Sublattices and the wave vectors that single them out.

A wave vector is three whole numbers over a common order n; it stands for a character of the lattice, and the sublattice
of a set of them holds the points on which all are whole. These sets are small: a sublattice of index n has n of them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np


def group(vectors, order: int) -> set[tuple[int, int, int]]:
    """All sums of vectors modulo the order; the empty set generates the zero vector."""
    out = {(0, 0, 0)}
    for v in vectors:
        multiples = {tuple(int(k * x) % order for x in v) for k in range(order)}
        out = {tuple((a + b) % order for a, b in zip(u, w)) for u in out for w in multiples}
    return out


def order_of(vector, order: int) -> int:
    """How often a vector is added to itself to come back to zero."""
    return math.lcm(*(order // math.gcd(int(x), order) for x in vector))


def matrix_of(vectors, order: int) -> np.ndarray:
    """Upper triangular matrix whose columns span the points where every vector over the order is whole.

    The form is unique: entries right of the diagonal are smaller than the diagonal of their row.
    """
    vectors = [tuple(map(int, v)) for v in vectors]
    is_whole = lambda x: all(sum(a * b for a, b in zip(v, x)) % order == 0 for v in vectors)
    a = next(n for n in range(1, order + 1) if is_whole((n, 0, 0)))
    b, d = next((n, d) for n in range(1, order + 1) for d in range(a) if is_whole((d, n, 0)))
    c, f, e = next((n, f, e) for n in range(1, order + 1) for f in range(b) for e in range(a) if is_whole((e, f, n)))
    return np.array([[a, d, e], [0, b, f], [0, 0, c]])


def vectors_of(matrix) -> tuple[set[tuple[int, int, int]], int]:
    """All wave vectors that are whole on the columns of a matrix, and their common order (the index)."""
    m = np.asarray(matrix)
    n = abs(round(np.linalg.det(m)))
    dual = np.rint(np.linalg.inv(m).T * n).astype(int)
    return group([tuple(c) for c in dual.T], n), n


def generating_set(vectors, order: int) -> list[tuple[int, int, int]]:
    """A smallest list of vectors that generates the same group: the first such list in sorted order."""
    whole = sorted(group(vectors, order))
    for size in range(4):  # a group of characters of a lattice of rank three needs three at most
        for chosen in itertools.combinations(whole, size):
            if math.prod(order_of(v, order) for v in chosen) == len(whole) and len(group(chosen, order)) == len(whole):
                return list(chosen)
    raise ValueError("vectors are not over one order")
