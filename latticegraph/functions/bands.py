"""Elastic bands: chains of images between two ends that settle on a path of least energy, with a climbing image.

A band lives in a space that says how far apart two images are, how an image moves, and what energies and forces images
have. In a crystal the coordinates of an image are its atoms in real space and its cell; a strain counts as a length by
the factor that a volume per atom and the number of atoms give, so that cell and atoms move on one scale.
"""

from __future__ import annotations

import numpy as np

from . import forces as F
from .forces import FIRE


class FlatSpace:
    """Vectors (d,) with a function that gives the energies and gradients of many (m, d)."""

    def __init__(self, gradients):
        self.gradients = gradients

    def between(self, a, b):
        return np.asarray(b, float) - np.asarray(a, float)

    def moved(self, images, moves):
        return [np.asarray(x, float) + m for x, m in zip(images, moves)]

    def pulled(self, images):
        energies, gradients = self.gradients(np.array(images, float))
        return np.asarray(energies, float), -np.asarray(gradients, float)


class CrystalSpace:
    """Crystals (cell, fractions) of one atom count; moves are (n + 3, 3), atoms before the strain times its factor."""

    def __init__(self, calculator, ends, weight: float = 1.0):
        self.calculator, n = calculator, len(ends[0][1])
        volume = np.mean([abs(np.linalg.det(c)) for c, _ in ends])
        self.factor = weight * (volume / n) ** (1 / 3) * n**0.5

    def between(self, a, b):
        middle = (a[0] + b[0]) / 2
        apart = b[1] - a[1]
        strain = np.linalg.solve(middle, b[0] - a[0])
        return np.concatenate([(apart - np.rint(apart)) @ middle, self.factor * (strain + strain.T) / 2])

    def moved(self, images, moves):
        moves = np.asarray(moves)
        cells, fractions = F.strained(np.array([c for c, _ in images]), np.array([f for _, f in images]), moves[:, :-3], moves[:, -3:] / self.factor)
        return list(zip(cells, fractions))

    def pulled(self, images):
        return pulled_together([self], [images])[0]


def pulled_together(spaces, asked) -> list[tuple[np.ndarray, np.ndarray]]:
    """Energies and forces of the images of many crystal spaces of one calculator and atom count, computed at once."""
    images = [x for own in asked for x in own]
    cells, fractions = np.array([c for c, _ in images]), np.array([f for _, f in images])
    energies, *grads = spaces[0].calculator.gradients(cells, fractions)
    on_atoms, virial = F.forces(cells, *grads)
    out, at = [], 0
    for space, own in zip(spaces, asked):
        part = slice(at, at := at + len(own))
        out.append((energies[part], np.concatenate([on_atoms[part], virial[part] / space.factor], 1)))
    return out


def _norm(x) -> float:
    return float(np.sqrt((np.asarray(x) ** 2).sum()))


def lengths(space, images) -> np.ndarray:
    """Distances between neighbouring images."""
    return np.array([_norm(space.between(a, b)) for a, b in zip(images, images[1:])])


def resampled(space, images, count: int) -> list:
    """So many images evenly spaced along a chain, ends included, between its neighbouring images."""
    along = np.concatenate([[0], np.cumsum(lengths(space, images))])
    out = []
    for at in np.linspace(0, along[-1], count)[1:-1]:
        k = min(int(np.searchsorted(along, at, "right")) - 1, len(images) - 2)
        part = (at - along[k]) / max(along[k + 1] - along[k], 1e-300)
        out += space.moved([images[k]], [part * space.between(images[k], images[k + 1])])
    return [images[0], *out, images[-1]]


def tangents(space, images, energies) -> tuple[np.ndarray, np.ndarray]:
    """Unit tangents at the inner images, towards the higher neighbour, and how much further the next image is than the last."""
    steps = [space.between(a, b) for a, b in zip(images, images[1:])]
    out, uneven = [], []
    for k in range(1, len(images) - 1):
        before, after, up, down = steps[k - 1], steps[k], energies[k + 1] - energies[k], energies[k - 1] - energies[k]
        if up > 0 >= down:
            t = after
        elif down > 0 >= up:
            t = before
        else:  # at a top or a bottom both count, the higher side more
            high, low = max(abs(up), abs(down)), min(abs(up), abs(down))
            t = after * high + before * low if energies[k + 1] > energies[k - 1] else after * low + before * high
            if high == 0:
                t = after + before
        out.append(t / max(_norm(t), 1e-300))
        uneven.append(_norm(after) - _norm(before))
    return np.array(out), np.array(uneven)


def settle(space, images, *, spring: float = 5.0, climbing: bool = True, force: float = 0.05, max_steps: int = 1000, longest: float = 0.1):
    """Images of the settled band, their energies, the largest force left and the steps taken (FIRE over all inner images)."""
    return settle_all([space], [images], lambda _, asked: [space.pulled(asked[0])], spring=spring, climbing=climbing, force=force, max_steps=max_steps, longest=longest)[0]


def settle_all(spaces, bands, pulled=pulled_together, **bounds) -> list[tuple]:
    """settle() of many bands, each in its space, step by step together, so that a step asks the calculator once."""
    steps = [_settling(space, images, **bounds) for space, images in zip(spaces, bands)]
    asked, out = {k: next(step) for k, step in enumerate(steps)}, [None] * len(steps)
    while asked:
        given = pulled([spaces[k] for k in asked], list(asked.values()))
        asked, now = {}, list(asked)
        for k, answer in zip(now, given):
            try:
                asked[k] = steps[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
    return out


def _settling(space, images, *, spring: float = 5.0, climbing: bool = True, force: float = 0.05, max_steps: int = 1000, longest: float = 0.1):
    """A generator that asks for energies and forces of images and returns what settle() gives.

    The ends stay. Forces act across the band, springs along it; the highest inner image has no spring and climbs along
    the band, from when the forces are near ten times the limit.
    """
    images = list(images)
    (first, last), _ = yield [images[0], images[-1]]
    if len(images) < 3:
        return images, np.array([first, last]), 0.0, 0
    speed, dt, mix, good, left, climbs = 0.0, FIRE["dt"], FIRE["mix"], 0, np.inf, False
    for step in range(max_steps + 1):
        inner, pull = yield images[1:-1]
        energies = np.concatenate([[first], inner, [last]])
        along, uneven = tangents(space, images, energies)
        shape = (-1,) + (1,) * (along.ndim - 1)
        part = (pull * along).reshape(len(along), -1).sum(1)
        net = pull - part.reshape(shape) * along + (spring * uneven).reshape(shape) * along
        top = int(inner.argmax())
        climbs = climbs or climbing and left < 10 * force
        if climbs:
            net[top] = pull[top] - 2 * part[top] * along[top]
        left = float(np.sqrt((net.reshape(len(net), -1) ** 2).sum(1)).max())
        if left <= force and (climbs or not climbing) or step == max_steps:
            return images, energies, left, step
        if (net * speed).sum() > 0:
            speed = (1 - mix) * speed + mix * _norm(speed) / max(_norm(net), 1e-300) * net
            good += 1
            if good > FIRE["wait"]:
                dt, mix = min(dt * FIRE["grow"], FIRE["dt_most"]), mix * FIRE["mix_loss"]
        else:
            speed, dt, mix, good = np.zeros_like(net), dt * (FIRE["shrink"] if step else 1), FIRE["mix"], 0
        speed = speed + dt * net
        move = dt * speed
        each = np.sqrt((move.reshape(len(move), -1) ** 2).sum(1))
        move = move * np.minimum(1, longest / np.maximum(each, 1e-300)).reshape(shape)
        images = [images[0], *space.moved(images[1:-1], move), images[-1]]
