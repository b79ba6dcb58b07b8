"""Energies with gradients for many crystals of one atom count, and their relaxation in continuous space.

Arrays hold b crystals: cells (b, 3, 3) with vectors as rows, fractions (b, n, 3). A gradient is taken by fractions and by
cell; forces act on atoms in real space, and the virial is the gradient by a symmetric strain of the cell.
"""

from __future__ import annotations

import math

import numpy as np

from .geometry import _cells

#: Distances of one block of the neighbour search.
_BLOCK = 1 << 20


def neighbour_lists(cells: np.ndarray, fractions: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every atom its k nearest others in the infinite crystal: their places (b, n, k) and whole cells between (b, n, k, 3)."""
    b, n, _ = fractions.shape
    heights = 1 / np.linalg.norm(np.linalg.inv(cells), axis=1)
    radius = 1.4 * (3 * (k + 1) * np.abs(np.linalg.det(cells)) / (4 * math.pi * n)) ** (1 / 3)
    whole = np.floor(fractions)
    inside = fractions - whole
    place, shift = np.zeros((b, n, k), int), np.zeros((b, n, k, 3))
    left = np.arange(b)
    while len(left):
        need = (radius[left, None] / heights[left]).astype(int) + 1
        again = []
        for span in np.unique(need, axis=0):
            images = _cells(*span)
            own = left[(need == span).all(1)]
            if n * len(images) <= k:
                again.append(own)
                continue
            for part in np.array_split(own, max(1, len(own) * n * n * len(images) // _BLOCK)):
                apart = inside[part][:, None, :, None] - inside[part][:, :, None, None] + images
                squares = ((apart @ cells[part][:, None, None]) ** 2).sum(-1).reshape(len(part), n, -1)
                near = np.argpartition(squares, k, 2)[..., : k + 1]
                found = np.take_along_axis(squares, near, 2)
                order = np.argsort(found, 2, kind="stable")[..., 1:]
                near, found = np.take_along_axis(near, order, 2), np.take_along_axis(found, order, 2)
                to = near // len(images)
                place[part] = to
                w = whole[part]
                shift[part] = images[near % len(images)] + w[:, :, None] - np.take_along_axis(w, to.reshape(len(part), -1, 1), 1).reshape(to.shape + (3,))
                again.append(part[found[..., -1].max(1) > radius[part] ** 2])
        left = np.concatenate(again)
        radius[left] *= 1.3
    return place, shift


def near_distances(cells: np.ndarray, fractions: np.ndarray, k: int) -> np.ndarray:
    """geometry.near_distances() of every crystal: (b, n, k)."""
    b, n, _ = fractions.shape
    place, shift = neighbour_lists(cells, fractions, k)
    others = np.take_along_axis(fractions, place.reshape(b, -1, 1), 1).reshape(b, n, k, 3)
    return np.sqrt((((others + shift - fractions[:, :, None]) @ cells[:, None]) ** 2).sum(-1))


def pair_gradients(cells: np.ndarray, fractions: np.ndarray, length: float = 3.0, k: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """geometry.pair_energy() of every crystal, and its gradients by fractions and by cell.

    The gradient is that of the k nearest neighbours as they stand; distances below half the length no longer count.
    """
    b, n, _ = fractions.shape
    place, shift = neighbour_lists(cells, fractions, k)
    others = np.take_along_axis(fractions, place.reshape(b, -1, 1), 1).reshape(b, n, k, 3)
    apart = others + shift - fractions[:, :, None]
    vectors = apart @ cells[:, None]
    r = np.sqrt((vectors**2).sum(-1))
    far = np.maximum(r, length / 2)
    q = (length / far) ** 3
    energies = (q * q - 2 * q).sum((1, 2)) / 2
    slope = np.where(r > length / 2, -6 * q * q + 6 * q, 0) / far / 2
    pull = slope[..., None] * vectors / np.maximum(r, 1e-300)[..., None]
    by_fraction = pull @ np.swapaxes(cells, 1, 2)[:, None]
    grad = -by_fraction.sum(2)
    row = np.repeat(np.arange(b), n * k)
    np.add.at(grad, (row, place.ravel()), by_fraction.reshape(-1, 3))
    return energies, grad, np.einsum("bnki,bnkj->bij", apart, pull)


def numeric_gradients(energies_of, cells: np.ndarray, fractions: np.ndarray, step: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by central differences of energies_of(list of (cell, fractions)), for calculators without gradients."""
    b, n, _ = fractions.shape
    width = 3 * n + 9
    flat = np.concatenate([fractions.reshape(b, -1), cells.reshape(b, -1)], 1)
    moves = np.concatenate([np.zeros((1, width)), step * np.eye(width), -step * np.eye(width)])
    many = (flat[:, None] + moves).reshape(-1, width)
    values = np.asarray(energies_of([(x[3 * n :].reshape(3, 3), x[: 3 * n].reshape(n, 3)) for x in many]), float).reshape(b, -1)
    slope = (values[:, 1 : width + 1] - values[:, width + 1 :]) / (2 * step)
    return values[:, 0], slope[:, : 3 * n].reshape(b, n, 3), slope[:, 3 * n :].reshape(b, 3, 3)


def forces(cells: np.ndarray, by_fraction: np.ndarray, by_cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forces on atoms (b, n, 3) and the virial (b, 3, 3), minus the gradient by a strain that turns nothing."""
    strain = np.swapaxes(cells, 1, 2) @ by_cell
    return -by_fraction @ np.swapaxes(np.linalg.inv(cells), 1, 2), -(strain + np.swapaxes(strain, 1, 2)) / 2


def strained(cells: np.ndarray, fractions: np.ndarray, moves: np.ndarray, strains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Crystals after atoms moved in real space and the cell, with them, was strained."""
    return cells @ (np.eye(3) + strains), fractions + moves @ np.linalg.inv(cells)


#: Fixed values of the minimiser: first and largest time step, growth and loss of it, mixing and its loss, steps before growth.
FIRE = {"dt": 0.1, "dt_most": 1.0, "grow": 1.1, "shrink": 0.5, "mix": 0.1, "mix_loss": 0.99, "wait": 5}


def relax_cells(calculator, cells: np.ndarray, fractions: np.ndarray, *, force: float = 0.01, max_steps: int = 500, longest: float = 0.2):
    """Cells, fractions, energies, largest forces and steps after minimisation of atoms and cell together (FIRE).

    A step that would raise the energy of a crystal is taken back and its time step halved, so energies never rise. A
    crystal is done when no force, and no row of the virial by atom, is longer than force.
    """
    cells, fractions = np.array(cells, float), np.array(fractions, float)
    b, n, _ = fractions.shape
    energies, *grads = calculator.gradients(cells, fractions)
    on_atoms, virial = forces(cells, *grads)
    pull = np.concatenate([on_atoms, virial / n], 1)
    speed, dt, mix, good, steps = np.zeros_like(pull), np.full(b, FIRE["dt"]), np.full(b, FIRE["mix"]), np.zeros(b, int), np.zeros(b, int)
    size = lambda x: np.sqrt((x**2).sum((1, 2)))
    for _ in range(max_steps):
        at = np.flatnonzero((np.sqrt((pull**2).sum(2)).max(1) > force) & (dt > 1e-9))
        if not len(at):
            break
        f, v = pull[at], speed[at]
        along = (f * v).sum((1, 2)) > 0
        v = np.where(along[:, None, None], (1 - mix[at])[:, None, None] * v + (mix[at] * size(v) / np.maximum(size(f), 1e-300))[:, None, None] * f, 0)
        good[at] = np.where(along, good[at] + 1, 0)
        faster = along & (good[at] > FIRE["wait"])
        dt[at] = np.where(faster, np.minimum(dt[at] * FIRE["grow"], FIRE["dt_most"]), np.where(along, dt[at], dt[at] * np.where(steps[at] > 0, FIRE["shrink"], 1)))
        mix[at] = np.where(faster, mix[at] * FIRE["mix_loss"], np.where(along, mix[at], FIRE["mix"]))
        v = v + dt[at, None, None] * f
        move = dt[at, None, None] * v
        move *= np.minimum(1, longest / np.maximum(size(move), 1e-300))[:, None, None]
        new_cells, new_fractions = strained(cells[at], fractions[at], move[:, :n], move[:, n:] / n)
        new_energies, *grads = calculator.gradients(new_cells, new_fractions)
        steps[at] += 1
        fine = new_energies <= energies[at]
        kept = at[fine]
        cells[kept], fractions[kept], energies[kept] = new_cells[fine], new_fractions[fine], new_energies[fine]
        if len(kept):
            on_atoms, virial = forces(cells[kept], *(g[fine] for g in grads))
            pull[kept] = np.concatenate([on_atoms, virial / n], 1)
        speed[at] = np.where(fine[:, None, None], v, 0)
        back = at[~fine]
        dt[back], mix[back], good[back] = dt[back] * FIRE["shrink"], FIRE["mix"], 0
    return cells, fractions, energies, np.sqrt((pull**2).sum(2)).max(1), steps
