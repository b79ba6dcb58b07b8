"""Fixed tables of superbases, and Selling reduction and canonical vonorms over NumPy batches.

Conorms are stored doubled, as whole numbers; a batch is an array with one lattice per row.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np

#: Order of the six conorms.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: Characters of L/2L that go with the six conorms, and the seventh, whose conorm is zero in an obtuse superbasis.
CHARACTERS = ((1, 1, 0), (1, 0, 1), (1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1), (1, 1, 1))
#: Classes of L/2L of the seven vonorms: v0, v1, v2, v3, v0 + v1, v0 + v2, v0 + v3.
CLASSES = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))
#: Places of the characters that a vonorm is minus the sum of.
SUPPORT = tuple(tuple(k for k, x in enumerate(CHARACTERS) if sum(a * b for a, b in zip(x, s)) % 2) for s in CLASSES)
#: A vector is shortened by multiples of another at once while so many or more fit; smaller steps are Selling steps.
COARSE = 8


def selling_step_places(pair: int) -> list[tuple[int, ...]]:
    """How each new conorm is formed when the given pair is positive: signed places (place + 1) to add up."""
    i, j = PAIRS[pair]
    k, m = (x for x in range(4) if x not in (i, j))
    at = lambda a, b: PAIRS.index((min(a, b), max(a, b))) + 1
    p = pair + 1
    new = {p: (-p,), at(i, k): (p, at(i, m)), at(i, m): (p, at(i, k)), at(j, k): (at(j, k), p), at(j, m): (at(j, m), p), at(k, m): (at(k, m), -p)}
    return [new[q + 1] for q in range(6)]


@lru_cache(1)
def automorphisms() -> tuple[tuple[int, ...], ...]:
    """The 168 permutations of the seven characters that a change of basis modulo two induces."""
    rows = [r for r in itertools.product((0, 1), repeat=3) if any(r)]
    out = set()
    for m in itertools.product(rows, repeat=3):
        image = [tuple(sum(m[r][c] * x[c] for c in range(3)) % 2 for r in range(3)) for x in CHARACTERS]
        if all(any(v) for v in image) and len(set(image)) == 7:
            out.add(tuple(CHARACTERS.index(v) for v in image))
    return tuple(sorted(out))


def permissible(mask: int) -> list[tuple[int, ...]]:
    """Automorphisms that leave a zero conorm in the seventh place."""
    return [p for p in automorphisms() if p[6] == 6 or mask >> p[6] & 1]


def possible_masks() -> list[int]:
    """Zero sets of obtuse superbases: no vector of a lattice has length zero, so at most three zeros, never all of one vector."""
    out = []
    for mask in range(64):
        zeros = {k for k in range(6) if mask >> k & 1}
        full = [{k for k, p in enumerate(PAIRS) if v in p} for v in range(4)]
        if len(zeros) <= 3 and not any(f <= zeros for f in full):
            out.append(mask)
    return out


# ---------------------------------------------------------------- batches


def _turn_matrix(pair: int) -> np.ndarray:
    """New superbasis vectors, as combinations of the old, after a Selling step on a pair."""
    i, j = PAIRS[pair]
    out = np.eye(4, dtype=np.int64)
    out[:, i] += 1
    out[i], out[j] = 0, 0
    out[i, i], out[j, j] = -1, 1
    return out


_TURNS = np.array([_turn_matrix(p) for p in range(6)])
_SELLING = np.array([[[sum(int(np.sign(t)) * (abs(t) - 1 == c) for t in ts) for c in range(6)] for ts in selling_step_places(p)] for p in range(6)])
_SUPPORT = np.array([[int(k in s) for k in range(7)] for s in SUPPORT])


def zero_masks(d: np.ndarray) -> np.ndarray:
    """Bit k is set where conorm k is zero."""
    return (d == 0) @ (1 << np.arange(6))


def vonorms_of(d: np.ndarray) -> np.ndarray:
    """The seven vonorms of doubled conorms."""
    return -(d @ _SUPPORT[:, :6].T) // 2


def _subtract_multiples(d: np.ndarray, rows: np.ndarray | None) -> None:
    """Shorten the first three vectors by multiples of each other, in place; the fourth stays minus their sum."""
    todo = np.arange(len(d))
    while len(todo):
        changed = np.zeros(len(todo), bool)
        for i, j in itertools.permutations(range(3), 2):
            own = d[todo]
            norm = -sum(own[:, k] for k, p in enumerate(PAIRS) if i in p)
            product = own[:, PAIRS.index((min(i, j), max(i, j)))]
            hit = (norm > 0) & (np.abs(product) > COARSE * norm)
            if not hit.any():
                continue
            changed |= hit
            at, q = todo[hit], (2 * product[hit] + norm[hit]) // (2 * norm[hit])
            # vector j loses q times vector i, and the fourth gains it
            change = np.tile(np.eye(4, dtype=np.int64), (len(at), 1, 1))
            change[:, j, i], change[:, 3, i] = -q, q
            gram = np.zeros((len(at), 4, 4), np.int64)
            for k, (a, b) in enumerate(PAIRS):
                gram[:, a, b] = gram[:, b, a] = d[at, k]
            for a in range(4):
                gram[:, a, a] = -gram[:, a].sum(1)
            gram = change @ gram @ change.transpose(0, 2, 1)
            d[at] = gram[:, [a for a, _ in PAIRS], [b for _, b in PAIRS]]
            if rows is not None:
                rows[at] = change @ rows[at]
        todo = todo[changed]


def selling(d: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Doubled conorms (n, 6) of obtuse superbases of the same lattices, whatever the number of steps.

    The largest conorm is removed until none is positive. rows (n, 4, k), if given, are turned along. Numbers that are
    the conorms of no lattice raise ValueError.
    """
    d = np.array(d, np.int64).reshape(-1, 6)
    rows = None if rows is None else np.array(rows, np.int64)
    _subtract_multiples(d, rows)
    todo = np.flatnonzero(d.max(1, initial=0) > 0)
    while len(todo):
        own = d[todo]
        if (own.sum(1) > 0).any():  # the squared lengths add up to minus the sum
            raise ValueError("these are the conorms of no lattice")
        pair = own.argmax(1)
        d[todo] = np.einsum("nij,nj->ni", _SELLING[pair], own)
        if rows is not None:
            rows[todo] = _TURNS[pair] @ rows[todo]
        todo = todo[d[todo].max(1) > 0]
    return d, rows


@lru_cache(64)
def _places(mask: int) -> np.ndarray:
    """Places of the vonorms under the permissible permutations, each once."""
    support = {frozenset(s): k for k, s in enumerate(SUPPORT)}
    return np.array(sorted({tuple(support[frozenset(p[c] for c in s)] for s in SUPPORT) for p in permissible(mask)}))


def smallest(images: np.ndarray) -> np.ndarray:
    """Which of the images (n, t, w) are the lexicographically smallest of their row."""
    keep = np.ones(images.shape[:2], bool)
    for k in range(images.shape[2]):
        column = np.where(keep, images[:, :, k], np.iinfo(np.int64).max)
        keep &= column == column.min(1, keepdims=True)
    return keep


def canonical_vonorms(d: np.ndarray) -> np.ndarray:
    """The lexicographically smallest vonorms of obtuse superbases (n, 6), over their permissible permutations."""
    v, masks = vonorms_of(d), zero_masks(d)
    out = np.empty_like(v)
    for mask in np.unique(masks):
        at = np.flatnonzero(masks == mask)
        for part in np.array_split(at, len(at) // 4096 + 1):
            images = v[part][:, _places(int(mask))]
            out[part] = images[np.arange(len(part)), smallest(images).argmax(1)]
    return out
