"""Real geometry in NumPy: reconstruction, distances between periodic sets, assignment, a pair energy."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np

_IMAGES = np.array(list(itertools.product((-1, 0, 1), repeat=3)))


def cell_from_vonorms(v, xi: float = 1.0) -> np.ndarray:
    """Three vectors (rows) with the given vonorms, the first along x and the second in the xy plane."""
    v = np.asarray(v, float) * xi
    a, b, c = v[:3]
    if min(a, b, c) <= 0:
        raise ValueError("a lattice vector has no length")
    ab, ac, bc = (v[4] - a - b) / 2, (v[5] - a - c) / 2, (v[6] - b - c) / 2
    return cell_from_gram(np.array([[a, ab, ac], [ab, b, bc], [ac, bc, c]]))


def cell_from_gram(g: np.ndarray) -> np.ndarray:
    """Lower triangular vectors with these dot products; rounding below zero counts as a flat cell."""
    out = np.zeros((3, 3))
    for i in range(3):
        for j in range(i):
            out[i, j] = (g[i, j] - out[i, :j] @ out[j, :j]) / out[j, j] if out[j, j] else 0.0
        out[i, i] = math.sqrt(max(0.0, g[i, i] - out[i, :i] @ out[i, :i]))
    return out


def lower_triangular(cell: np.ndarray) -> np.ndarray:
    """The same cell turned so that the first vector lies along x and the second in the xy plane."""
    return cell_from_gram(np.asarray(cell, float) @ np.asarray(cell, float).T)


def cell_parameters(cell: np.ndarray) -> tuple[float, ...]:
    """Lengths and angles in degrees."""
    a, b, c = np.linalg.norm(cell, axis=1)
    angle = lambda i, j: math.degrees(math.acos(np.clip(cell[i] @ cell[j] / np.linalg.norm(cell[i]) / np.linalg.norm(cell[j]), -1, 1)))
    return a, b, c, angle(1, 2), angle(0, 2), angle(0, 1)


def cell_from_parameters(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    return cell_from_gram(np.array([[a * a, a * b * cg, a * c * cb], [a * b * cg, b * b, b * c * ca], [a * c * cb, b * c * ca, c * c]]))


def pair_distances(cell: np.ndarray, fractions: np.ndarray) -> np.ndarray:
    """Distances of all pairs i < j, each the least over the 27 cells around."""
    i, j = np.triu_indices(len(fractions), 1)
    apart = (fractions[j] - fractions[i])[:, None] + _IMAGES
    return np.linalg.norm(apart @ cell, axis=2).min(1)


def shortest_bond(cell: np.ndarray, fractions: np.ndarray) -> float:
    """The least pair distance; infinite for one atom."""
    return float(pair_distances(cell, fractions).min(initial=math.inf))


def near_distances(cell: np.ndarray, fractions: np.ndarray, k: int) -> np.ndarray:
    """Sorted distances of every atom to its k nearest others in the infinite crystal."""
    heights = 1 / np.linalg.norm(np.linalg.inv(cell), axis=0)
    radius = 1.4 * (3 * (k + 1) * abs(np.linalg.det(cell)) / (4 * math.pi * len(fractions))) ** (1 / 3)
    fractions = fractions % 1
    starts = (fractions @ cell)[None, :] - (fractions @ cell)[:, None]
    while True:
        cells = _cells(*(int(radius / h) + 1 for h in heights)) @ cell
        apart = (starts[:, :, None] + cells).reshape(len(fractions), -1, 3)
        squares = np.einsum("nij,nij->ni", apart, apart)
        if squares.shape[1] > k:
            near = np.sort(np.partition(squares, k, 1)[:, : k + 1], 1)[:, 1:]
            if near[:, -1].max() <= radius * radius:
                return np.sqrt(near)
        radius *= 1.3


@lru_cache(256)
def _cells(i: int, j: int, k: int) -> np.ndarray:
    return np.array(list(itertools.product(range(-i, i + 1), range(-j, j + 1), range(-k, k + 1))), float)


def amd(cell: np.ndarray, fractions: np.ndarray, k: int = 100) -> np.ndarray:
    """Average minimum distances."""
    return near_distances(cell, fractions, k).mean(0)


def amd_distance(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.abs(x - y).max())


def pdd_distance(x: np.ndarray, y: np.ndarray) -> float:
    """Earth mover's distance between two sets of distance rows of equal weight; rows cost their largest difference."""
    n = math.lcm(len(x), len(y))
    cost = np.abs(x[:, None] - y[None]).max(2)
    cost = np.repeat(np.repeat(cost, n // len(x), 0), n // len(y), 1)
    return float(cost[np.arange(n), assign(cost)].mean())


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of every row in an assignment of least cost (square), by shortest augmenting paths."""
    n = len(cost)
    up, left = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.full(n + 1, -1)
    for row in range(n):
        owner[n], at = row, n
        best, via, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            i = owner[at]
            slack = cost[i] - up[i] - left[:n]
            better = ~done[:n] & (slack < best)
            best[better], via[better] = slack[better], at
            step_at = int(np.where(done[:n], np.inf, best).argmin())
            step = best[step_at]
            up[owner[done]] += step
            left[done] -= step
            best[~done[:n]] -= step
            at = step_at
        while at != n:
            owner[at] = owner[via[at]]
            at = via[at]
    out = np.zeros(n, int)
    out[owner[:n]] = np.arange(n)
    return out


def match_atoms(cell: np.ndarray, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """For every atom of a its partner in b of the same label, and the sum of their squared distances.

    Differences are taken to the nearest whole cell along each edge.
    """
    partner, total = np.zeros(len(a), int), 0.0
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        apart = b[at][None] - a[at][:, None]
        cost = (((apart - np.rint(apart)) @ cell) ** 2).sum(2)
        to = assign(cost)
        partner[at] = at[to]
        total += float(cost[np.arange(len(at)), to].sum())
    return partner, total


def pair_energy(cell: np.ndarray, fractions: np.ndarray, length: float = 3.0) -> float:
    """A smooth stand-in for a potential: every neighbour distance r of an atom gives (l/r)^6 - 2 (l/r)^3, r at least l/2."""
    near = np.maximum(near_distances(cell, fractions, 12), length / 2)
    q = (length / near) ** 3
    return float((q * q - 2 * q).sum() / 2)


@lru_cache(4)
def unimodular(largest: int = 1) -> np.ndarray:
    """All matrices of determinant one whose entries are at most largest in size."""
    rows = np.array(list(itertools.product(range(-largest, largest + 1), repeat=3)))
    cross = np.cross(rows[:, None], rows[None])
    det = np.einsum("ik,jlk->ijl", rows, cross)
    i, j, k = np.nonzero(det == 1)
    return np.stack([rows[i], rows[j], rows[k]], 1)


def lattice_vectors(gram: np.ndarray, radius: float) -> np.ndarray:
    """All whole coordinates but zero whose vector is at most radius long, by Fincke and Pohst: the last coordinate first,
    each within what the ones behind it leave."""
    low = np.linalg.cholesky(np.asarray(gram, float))
    found, rest = np.zeros((1, 0)), np.array([radius * radius * (1 + 1e-12)])
    for k in (2, 1, 0):
        shift = found @ low[k + 1 :, k]
        reach = np.sqrt(np.maximum(rest, 0))
        least = np.ceil((-reach - shift) / low[k, k])
        many = np.maximum(np.floor((reach - shift) / low[k, k]) - least + 1, 0).astype(int)
        row = np.repeat(np.arange(len(found)), many)
        x = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        rest = rest[row] - (x * low[k, k] + shift[row]) ** 2
        found = np.concatenate([x[:, None], found[row]], 1)
    found = found.astype(int)
    return found[found.any(1)]


#: Triples of vectors looked at together.
_TRIPLES = 1 << 20


def changes_of_axes(first: np.ndarray, gram: np.ndarray, over: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of determinant one that bring a lattice (by its dot products) within reach of a lower triangular cell, but
    not within over: them, the lower triangular cells they give and how far off these are (Frobenius norm), nearest first.

    No entry is bounded: a row can only lie within reach of a target row if its length does, and all lattice vectors of
    such lengths are listed. Pairs and triples are kept while what they fix of the cell is within reach.
    """
    vectors = lattice_vectors(gram, np.linalg.norm(first, axis=1).max() + reach)
    dots = vectors @ gram @ vectors.T
    size = np.sqrt(np.diag(dots))
    rows = [np.flatnonzero(np.abs(size - np.linalg.norm(t)) <= reach) for t in first]
    i, j = (x.ravel() for x in np.meshgrid(rows[0], rows[1], indexing="ij"))
    b1 = dots[i, j] / size[i]
    b2 = np.sqrt(np.maximum(dots[j, j] - b1 * b1, 0))
    gap = (size[i] - first[0, 0]) ** 2 + (b1 - first[1, 0]) ** 2 + (b2 - first[1, 1]) ** 2
    keep = (gap <= reach * reach) & (b2 > 1e-9)
    i, j, b1, b2, gap = (x[keep] for x in (i, j, b1, b2, gap))
    third, volume = rows[2], math.sqrt(max(np.linalg.det(gram), 0))
    out = [(np.zeros((0, 3, 3), int), np.zeros((0, 3, 3)), np.zeros(0))]
    block = max(1, _TRIPLES // max(len(third), 1))
    for at in range(0, len(i), block):
        p, q, x1, x2, so_far = (x[at : at + block, None] for x in (i, j, b1, b2, gap))
        c1 = dots[p, third] / size[p]
        c2 = (dots[q, third] - x1 * c1) / x2
        c3 = volume / (size[p] * x2)
        whole = so_far + (c1 - first[2, 0]) ** 2 + (c2 - first[2, 1]) ** 2 + (c3 - first[2, 2]) ** 2
        m, k = np.nonzero((whole <= reach * reach) & (whole > over * over if over else whole >= 0))
        turns = np.stack([vectors[p[m, 0]], vectors[q[m, 0]], vectors[third[k]]], 1)
        right = np.rint(np.linalg.det(turns)) == 1
        m, k = m[right], k[right]
        cells = np.zeros((len(m), 3, 3))
        cells[:, 0, 0], cells[:, 1, 0], cells[:, 1, 1] = size[p[m, 0]], x1[m, 0], x2[m, 0]
        cells[:, 2, 0], cells[:, 2, 1], cells[:, 2, 2] = c1[m, k], c2[m, k], c3[m, 0]
        out.append((turns[right], cells, np.sqrt(whole[m, k])))
    turns, cells, gaps = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(gaps, kind="stable")
    return turns[order], cells[order], gaps[order]


def align(cell, fractions, next_cell, next_fractions, labels) -> tuple[np.ndarray, np.ndarray, float]:
    """The second crystal in the axes and the order of atoms that bring it nearest to the first, and the distance left.

    The distance is the Frobenius norm of the difference of the cells plus the sum of the squared distances of matched
    atoms. All changes of axes of determinant one count, and all shifts that take an atom of the first label to the first
    atom. Changes of axes are listed within a reach that doubles until the best distance lies within it, which no change
    outside can beat; orders of increasing cell difference end the search inside it, since atoms only add to it.
    """
    first, labels = lower_triangular(cell), np.asarray(labels)
    at, to = np.asarray(fractions, float), np.asarray(next_fractions, float)
    gram = np.asarray(next_cell, float) @ np.asarray(next_cell, float).T
    best, over, reach = (math.inf, None, None), 0.0, 0.05 * np.linalg.norm(first, axis=1).min()
    while True:
        turns, cells, gaps = changes_of_axes(first, gram, over, reach)
        for turn, new, gap in zip(turns, cells, gaps):
            if gap >= best[0]:
                break
            moved = to @ np.rint(np.linalg.inv(turn))
            for o in np.flatnonzero(labels == labels[0]):
                shifted = (moved - moved[o] + at[0]) % 1
                partner, cost = match_atoms(first, at, shifted, labels)
                if gap + cost < best[0]:
                    best = (float(gap + cost), new, shifted[partner])
        if best[0] <= reach:
            return best[1], best[2], best[0]
        over, reach = reach, min(2 * reach, best[0])


def align_path(cells, fractions, labels) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Every crystal of a path in axes near those of the one before it, with the distance left at every step."""
    out_cells, out_at, left = [lower_triangular(cells[0])], [np.asarray(fractions[0], float)], [0.0]
    for cell, at in zip(cells[1:], fractions[1:]):
        cell, at, gap = align(out_cells[-1], out_at[-1], cell, at, labels)
        out_cells.append(cell)
        out_at.append(at)
        left.append(gap)
    return out_cells, out_at, left
