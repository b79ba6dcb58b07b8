"""Crystals in NumPy: orientations of obtuse superbases, canonical keys and neighbours of keys.

These run inside Arrow-batched functions. A key is the seven canonical vonorms followed by three coordinates for every
atom but the first, which lies at the origin. Atoms are told apart by labels: 0 for those of the first element, then 1,
2 and so on. Everything is integer; coordinates count delta-ths of a cell edge.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np

from . import forms, lattice

_SUPPORT = np.array([[int(k in s) for k in range(7)] for s in lattice.SUPPORT])
_STEPS = np.array(lattice.step_vectors())
_PLACE = {frozenset(p): k for k, p in enumerate(lattice.PAIRS)}
#: Moves of one atom: along each axis and along the body diagonal, both ways.
_MOVES = np.array([s * np.array(m) for m in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)) for s in (1, -1)])


def doubled_conorms(v: np.ndarray) -> np.ndarray:
    """Like lattice.doubled_conorms, over the last axis."""
    p, s = v[..., :4], v[..., 4:]
    return np.stack([s[..., 0] - p[..., 0] - p[..., 1], s[..., 1] - p[..., 0] - p[..., 2], s[..., 2] - p[..., 0] - p[..., 3], s[..., 2] - p[..., 1] - p[..., 2], s[..., 1] - p[..., 1] - p[..., 3], s[..., 0] - p[..., 2] - p[..., 3]], -1)


def _turned(rows: np.ndarray, pair: int) -> np.ndarray:
    """Superbasis after a Selling step on a pair; the rows are its four vectors."""
    i, j = lattice.PAIRS[pair]
    out = rows + rows[i]
    out[i], out[j] = -rows[i], rows[j]
    return out


@lru_cache(64)
def orientations(mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All obtuse superbases of a lattice with this zero set: places of the conorms, of the vonorms, inverse matrices.

    They are reached from the first one by relabelling its vectors and by Selling steps on zero conorms, which keep all
    conorms but swap two of them; matrices have determinant one. The columns of a matrix are the new vectors.
    """
    zeros = {k for k in range(6) if mask >> k & 1} | {6}
    first = (tuple(range(7)), tuple(map(tuple, np.vstack([np.eye(3, dtype=int), -np.ones((1, 3), int)]).tolist())))
    known, todo = {first}, [first]
    relabel = [(s, [*(_PLACE[frozenset((s[i], s[j]))] for i, j in lattice.PAIRS), 6]) for s in itertools.permutations(range(4))]
    while todo:
        places, rows = todo.pop()
        m = np.array(rows)
        reached = [(tuple(places[k] for k in at), m[list(s)]) for s, at in relabel] + [(places, -m)]
        for pair, (i, j) in enumerate(lattice.PAIRS):
            if places[pair] in zeros:
                k, n = (x for x in range(4) if x not in (i, j))
                p = list(places)
                for a, b in ((pair, 6), (_PLACE[frozenset((i, k))], _PLACE[frozenset((i, n))])):
                    p[a], p[b] = p[b], p[a]
                reached.append((tuple(p), _turned(m, pair)))
        for p, r in reached:
            state = (p, tuple(map(tuple, r.tolist())))
            if state not in known:
                known.add(state)
                todo.append(state)
    proper = sorted(s for s in known if round(np.linalg.det(np.array(s[1][:3]))) == 1)
    places = np.array([p for p, _ in proper])
    support = {frozenset(s): k for k, s in enumerate(lattice.SUPPORT)}
    vonorm_places = np.array([[support[frozenset(p[c] for c in s)] for s in lattice.SUPPORT] for p in places.tolist()])
    inverses = np.array([np.rint(np.linalg.inv(np.array(r[:3]).T)).astype(int) for _, r in proper])
    return places, vonorm_places, inverses


def zero_mask(d: np.ndarray) -> int:
    return sum(1 << k for k in range(6) if d[k] == 0)


_FIRST = np.vstack([np.eye(3, dtype=np.int64), -np.ones((1, 3), np.int64)])


def reduce_all(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled conorms of obtuse superbases of the lattices (n, 7) and the inverses of the matrices that lead to them."""
    d, rows = forms.selling(doubled_conorms(np.asarray(v, np.int64)), np.tile(_FIRST, (len(v), 1, 1)))
    m = rows[:, :3].transpose(0, 2, 1)
    first, second, third = m[:, 0], m[:, 1], m[:, 2]
    # determinant one: the inverse is the adjugate
    m = m * (first * np.cross(second, third)).sum(1)[:, None, None]
    first, second, third = m[:, 0], m[:, 1], m[:, 2]
    return d, np.stack([np.cross(second, third), np.cross(third, first), np.cross(first, second)], 2)


def reduce(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vonorms of an obtuse superbasis of the same lattice and the inverse of the matrix that leads to it."""
    d, back = reduce_all(np.asarray(v)[None])
    return forms.vonorms_of(d)[0], back[0]


_POSSIBLE = np.isin(np.arange(64), forms.possible_masks())


def are_valid(v: np.ndarray) -> np.ndarray:
    """Whether vonorms (n, 7) are those of an obtuse superbasis with a possible zero set."""
    d = doubled_conorms(v)
    return (v[:, :4].sum(1) == v[:, 4:].sum(1)) & (d.max(1) <= 0) & _POSSIBLE[forms.zero_masks(d)]


def is_valid(v: np.ndarray) -> bool:
    return bool(are_valid(np.asarray(v)[None])[0])


#: Rows of turned motifs that are compared at once.
_ROWS = 1 << 18


def lattice_forms(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical vonorms of the lattices (n, 7), and (row, inverse) of all matrices that lead to them, sorted by row."""
    d, back = reduce_all(v)
    masks, w = forms.zero_masks(d), forms.vonorms_of(d)
    best, rows, turns = np.empty_like(w), [np.zeros(0, int)], [np.zeros((0, 3, 3), int)]
    for mask in np.unique(masks):
        _, places, inverses = orientations(int(mask))
        at = np.flatnonzero(masks == mask)
        for part in np.array_split(at, len(at) // 2048 + 1):
            images = w[part][:, places]
            keep = forms.smallest(images)
            best[part] = images[np.arange(len(part)), keep.argmax(1)]
            r, t = np.nonzero(keep)
            rows.append(part[r])
            turns.append(inverses[t] @ back[part[r]])
    row, turn = np.concatenate(rows), np.concatenate(turns)
    order = np.argsort(row, kind="stable")
    return best, row[order], turn[order]


def lattice_form(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical vonorms of one lattice and the inverses of all matrices that lead to them."""
    best, _, turns = lattice_forms(np.asarray(v)[None])
    return best[0], turns


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within the row of so many entries each."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def motif_forms(coords: np.ndarray, labels: np.ndarray, row: np.ndarray, turns: np.ndarray, delta: int) -> np.ndarray:
    """The smallest sorted coordinates of motifs (b, n, 3) over their turns and over which atom of label 0 is the origin.

    (row, turn) tells which turns a motif has, sorted by row, one at least each. One row of 3 (n - 1) values per motif.
    """
    b, n, _ = coords.shape
    if n == 1 or not b:
        return np.zeros((b, 3 * (n - 1)), int)
    origins = np.flatnonzero(labels == labels[0])
    first = np.searchsorted(row, np.arange(b + 1))
    best = np.empty((b, n), np.int64)
    low = 0
    while low < b:  # whole motifs, so many turns at a time
        high = max(low + 1, int(np.searchsorted(first, first[low] + _ROWS // (n * len(origins)), side="right")) - 1)
        own, begin = row[first[low] : first[high]], first[low:high] - first[low]
        turned = np.einsum("pij,pnj->pni", turns[first[low] : first[high]], coords[own])
        codes = np.empty((len(own), len(origins), n), np.int64)
        for k, o in enumerate(origins):
            x = np.mod(turned - turned[:, o : o + 1], delta)
            codes[:, k] = np.sort(((labels * delta + x[..., 0]) * delta + x[..., 1]) * delta + x[..., 2], -1)
        keep = np.ones(codes.shape[:2], bool)
        for k in range(1, n):  # the first is the origin itself; one column after another leaves the smallest rows
            column = np.where(keep, codes[:, :, k], np.iinfo(np.int64).max)
            keep &= column == np.minimum.reduceat(column.min(1), begin)[own - low][:, None]
        p, o = np.nonzero(keep)
        at = np.searchsorted(own[p], np.arange(low, high))
        best[low:high] = codes[p[at], o[at]]
        low = high
    rest = best[:, 1:]
    return np.stack([rest // delta**2 % delta, rest // delta % delta, rest % delta], -1).reshape(b, -1)


def canonical_keys(v: np.ndarray, coords: np.ndarray, labels: np.ndarray, delta: int) -> np.ndarray:
    """Keys of crystals (b, 7) and (b, n, 3) whose atoms have the same labels, in their order."""
    form, row, turns = lattice_forms(v)
    return np.concatenate([form, motif_forms(coords, labels, row, turns, delta)], 1)


def canonical_key(v, coords, labels, delta: int) -> tuple[int, ...]:
    """Key of one crystal: vonorms, flat coordinates of all atoms, labels."""
    coords = np.asarray(coords, int).reshape(1, -1, 3)
    return tuple(canonical_keys(np.asarray(v, int)[None], coords, np.asarray(labels, int), delta)[0].tolist())


def atoms_of(key) -> np.ndarray:
    """Coordinates of all atoms of a key, the one at the origin first."""
    return np.vstack([np.zeros((1, 3), int), np.asarray(key[7:], int).reshape(-1, 3)])


def _split_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vonorms and coordinates (b, n, 3) of keys."""
    rest = keys[:, 7:].reshape(len(keys), -1, 3)
    return keys[:, :7], np.concatenate([np.zeros((len(keys), 1, 3), np.int64), rest], 1)


def _distinct_motifs(row: np.ndarray, motifs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, motif), sorted by row."""
    n = motifs.shape[1]
    both = np.unique(np.concatenate([row[:, None], motifs.reshape(len(motifs), -1)], 1), axis=0)
    return both[:, 0], both[:, 1:].reshape(-1, n, 3)


def _starts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key row and vonorms of every start, and (start, inverse) of the orientations that show it.

    A start is the smallest member of a class of superbases that share their four primary vonorms.
    """
    masks = forms.zero_masks(doubled_conorms(v))
    rows, starts, of, turns, count = [np.zeros(0, int)], [np.zeros((0, 7), int)], [np.zeros(0, int)], [np.zeros((0, 3, 3), int)], 0
    for mask in np.unique(masks):
        _, places, inverses = orientations(int(mask))
        group = np.unique(np.sort(places[:, :4], 1), axis=0, return_inverse=True)[1].ravel()
        at = np.flatnonzero(masks == mask)
        images = v[at][:, places]
        least = np.stack([(part := images[:, group == g])[np.arange(len(at)), forms.smallest(part).argmax(1)] for g in range(group.max() + 1)], 1)
        for g in range(least.shape[1]):
            new = np.flatnonzero(~(least[:, :g] == least[:, g : g + 1]).all(2).any(1)) if g else np.arange(len(at))
            r, t = np.nonzero((images[new] == least[new, g][:, None]).all(2))
            rows.append(at[new])
            starts.append(least[new, g])
            of.append(count + r)
            turns.append(inverses[t])
            count += len(new)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(of), np.concatenate(turns)


def lattice_neighbour_rows(keys: np.ndarray, labels: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys one lattice step away, with the motif in each orientation that leads to the start."""
    v, atoms = _split_keys(keys)
    row, start, of, turns = _starts(v)
    of, motifs = _distinct_motifs(of, np.mod(np.einsum("pij,pnj->pni", turns, atoms[row[of]]), delta))
    moved = start[:, None] + _STEPS
    s, k = np.nonzero(are_valid(moved.reshape(-1, 7)).reshape(moved.shape[:2]))
    form, own, inverses = lattice_forms(moved[s, k])
    # every motif of the start on every lattice reached from it
    first = np.searchsorted(of, np.arange(len(start) + 1))
    lattice_at, place = _spread(np.diff(first)[s])
    motif_at = first[s][lattice_at] + place
    begin = np.searchsorted(own, np.arange(len(form) + 1))
    pair, place = _spread(np.diff(begin)[lattice_at])
    best = motif_forms(motifs[motif_at], labels, pair, inverses[begin[lattice_at[pair]] + place], delta)
    return row[s][lattice_at], np.concatenate([form[lattice_at], best], 1)


def motif_neighbour_rows(keys: np.ndarray, labels: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys one move of one atom away, in every orientation that keeps the lattice; the atom at the
    origin moves too."""
    v, atoms = _split_keys(keys)
    n = atoms.shape[1]
    if n == 1:
        return np.zeros(0, int), keys[:0]
    form, row, turns = lattice_forms(v)
    of, motifs = _distinct_motifs(row, np.mod(np.einsum("pij,pnj->pni", turns, atoms[row]), delta))
    moves = np.zeros((n * len(_MOVES), n, 3), int)
    for k in range(n):
        moves[k * len(_MOVES) : (k + 1) * len(_MOVES), k] = _MOVES
    moved = np.mod(motifs[:, None] + moves, delta).reshape(-1, n, 3)
    of, moved = _distinct_motifs(np.repeat(of, len(moves)), moved)
    begin = np.searchsorted(row, np.arange(len(keys) + 1))
    pair, place = _spread(np.diff(begin)[of])
    return of, np.concatenate([form[of], motif_forms(moved, labels, pair, turns[begin[of[pair]] + place], delta)], 1)


#: Kinds of neighbours.
KINDS = {"lattice": (lattice_neighbour_rows,), "motif": (motif_neighbour_rows,), "all": (lattice_neighbour_rows, motif_neighbour_rows)}


def neighbour_rows(keys: np.ndarray, labels: np.ndarray, delta: int, kind: str = "all") -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) of the neighbours of keys that share their labels, sorted, without the keys themselves."""
    found = [f(keys, labels, delta) for f in KINDS[kind]]
    both = np.concatenate([np.concatenate([row[:, None], key], 1) for row, key in found])
    both = np.unique(both, axis=0)
    both = both[(both[:, 1:] != keys[both[:, 0]]).any(1)]
    return both[:, 0], both[:, 1:]


def neighbours(key, labels, delta: int, kind: str = "all") -> list[tuple[int, ...]]:
    """Sorted distinct keys one step away, without the key itself."""
    return list(map(tuple, neighbour_rows(np.array([key], np.int64), np.asarray(labels, int), delta, kind)[1].tolist()))


def discretize_vonorms(v: np.ndarray, xi: float) -> np.ndarray:
    """Whole numbers of xi nearest to real vonorms, mended one unit at a time until the two sums agree.

    The cost of a unit compares xi times the real value with the whole number, as the stored keys in use do.
    """
    v = np.asarray(v, float)
    w = np.rint(v / xi).astype(int)
    while (gap := w[:4].sum() - w[4:].sum()) != 0:
        unit = np.where(np.arange(7) < 4, -np.sign(gap), np.sign(gap))
        cost = np.round(np.abs((v + unit) * xi - w) - np.abs(v * xi - w), 5)
        k = int(cost.argmin())
        w[k] += unit[k]
    return w


#: Resolution at which real coordinates are compared, and how near zero a real conorm counts as zero.
FINE, TOLERANCE = 100_000, 1e-4


def real_key(cell, fractions, labels, xi: float, delta: int) -> tuple[int, ...]:
    """Key of a crystal given by real vectors (rows) and fractions.

    The real lattice is reduced and put in canonical form with a tolerance, then rounded to xi and delta, and the rounded
    crystal is put in canonical form again, exactly.
    """
    basis = np.vstack([cell, -np.sum(cell, 0)])
    d, rows = np.array([2 * basis[i] @ basis[j] for i, j in lattice.PAIRS]), np.vstack([np.eye(3, dtype=int), -np.ones((1, 3), int)])
    for _ in range(500):
        if d.max() <= TOLERANCE:
            break
        rows = _turned(rows, int(np.round(d, 4).argmax()))
        turned = rows @ np.asarray(cell, float)
        d = np.array([2 * turned[i] @ turned[j] for i, j in lattice.PAIRS])
    else:
        raise ValueError("the lattice was not reduced in 500 steps")
    m = rows[:3].T
    back = np.rint(np.linalg.inv(m * round(np.linalg.det(m)))).astype(int)
    d[np.abs(d) <= TOLERANCE] = 0
    _, places, inverses = orientations(zero_mask(d))
    v = -(_SUPPORT[:, :6] @ d) / 2
    images = np.round(v[places], 4)
    best = images[np.lexsort(images.T[::-1])[0]]
    same = (images == best).all(1)
    turns = np.unique(inverses[same] @ back, axis=0)
    fine = np.rint(np.asarray(fractions, float) * FINE).astype(int)[None]
    labels = np.asarray(labels, int)
    motif = np.concatenate([np.zeros((1, 3), int), motif_forms(fine, labels, np.zeros(len(turns), int), turns, FINE)[0].reshape(-1, 3)])
    rounded = np.rint(motif * (delta / FINE)).astype(int) % delta
    return canonical_key(discretize_vonorms(v[places[same.argmax()]], xi), rounded, labels, delta)


#: Changes of a superbasis in a Selling step on each pair.
_TURNS = np.stack([_turned(np.eye(4, dtype=np.int64), k) for k in range(6)])
_LEFT, _RIGHT = (np.array([p[k] for p in lattice.PAIRS]) for k in (0, 1))


def real_keys(cells: np.ndarray, fractions: np.ndarray, labels, xi: float, delta: int) -> np.ndarray:
    """real_key() of crystals (b, 3, 3) and (b, n, 3) that share their labels, one row each."""
    cells, b = np.asarray(cells, float), len(cells)
    rows = np.tile(_FIRST, (b, 1, 1))
    dots = lambda at: 2 * np.einsum("nki,nki->nk", (basis := rows[at] @ cells[at])[:, _LEFT], basis[:, _RIGHT])
    d = dots(np.arange(b))
    for _ in range(500):
        at = np.flatnonzero(d.max(1) > TOLERANCE)
        if not len(at):
            break
        rows[at] = _TURNS[np.round(d[at], 4).argmax(1)] @ rows[at]
        d[at] = dots(at)
    else:
        raise ValueError("a lattice was not reduced in 500 steps")
    m = np.swapaxes(rows[:, :3], 1, 2)
    back = np.rint(np.linalg.inv(m * np.rint(np.linalg.det(m))[:, None, None])).astype(int)
    d[np.abs(d) <= TOLERANCE] = 0
    v = -(d @ _SUPPORT[:, :6].T) / 2
    masks, row, turns, shown = forms.zero_masks(d), [], [], np.empty((b, 7))
    for mask in np.unique(masks):
        _, places, inverses = orientations(int(mask))
        own = np.flatnonzero(masks == mask)
        best = forms.smallest(np.rint(np.round(v[own][:, places], 4) * 1e4).astype(np.int64))
        shown[own] = v[own[:, None], places[best.argmax(1)]]
        r, t = np.nonzero(best)
        row.append(own[r])
        turns.append(inverses[t] @ back[own[r]])
    row, turns = np.concatenate(row), np.concatenate(turns)
    both = np.unique(np.concatenate([row[:, None], turns.reshape(-1, 9)], 1), axis=0)
    fine = np.rint(np.asarray(fractions, float) * FINE).astype(int)
    labels = np.asarray(labels, int)
    motifs = motif_forms(fine, labels, both[:, 0], both[:, 1:].reshape(-1, 3, 3), FINE).reshape(b, -1, 3)
    rounded = np.rint(np.concatenate([np.zeros((b, 1, 3), int), motifs], 1) * (delta / FINE)).astype(int) % delta
    return canonical_keys(np.array([discretize_vonorms(x, xi) for x in shown]).reshape(-1, 7), rounded, labels, delta)


def supercell(cell, fractions, labels, matrix: np.ndarray):
    """Cell, fractions and labels of the supercell of an upper triangular matrix of whole numbers."""
    inverse = np.linalg.inv(matrix)
    moves = np.array(list(itertools.product(*(range(n) for n in np.diag(matrix)))))
    new = ((np.asarray(fractions)[:, None] + moves) @ inverse.T).reshape(-1, 3) % 1
    return matrix.T @ np.asarray(cell), new, np.repeat(labels, len(moves))


def hermite_matrices(index: int) -> list[np.ndarray]:
    """The matrices of operators.sublattice.hermite_matrices, for use inside a task."""
    out = []
    for a in (x for x in range(1, index + 1) if index % x == 0):
        for b in (x for x in range(1, index // a + 1) if index // a % x == 0):
            for d, e, f in itertools.product(range(a), range(a), range(b)):
                out.append(np.array([[a, d, e], [0, b, f], [0, 0, index // (a * b)]]))
    return out
