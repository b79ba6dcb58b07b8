"""Searches called from Python, without a session: a path between crystals, and its result as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np

from .functions import crystal, pathfinding
from .functions.calculators import PairCalculator, Provider


@dataclass
class PathResult:
    """What a search found: keys from a start to a goal, the energies along them and the points it expanded."""

    found: bool
    iterations: int
    path: list[list[int]] = field(default_factory=list)
    energies: list[float] = field(default_factory=list)

    @property
    def barrier(self) -> float | None:
        """The highest energy on the path; null without one."""
        return max(self.energies, default=None)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> PathResult:
        return cls(**json.loads(text))


def key_of(cell, fractions, labels, xi: float = 1.5, delta: int = 30) -> tuple[int, ...]:
    """Key of a crystal given by real vectors (rows), fractions and labels, atoms in the order of their labels."""
    return crystal.real_key(np.asarray(cell, float), np.asarray(fractions, float).reshape(-1, 3), labels, xi, delta)


def pathfind(
    starts: Sequence,
    goals: Sequence,
    labels: Sequence[int],
    *,
    xi: float = 1.5,
    delta: int = 30,
    heuristic: str | Callable = "manhattan",
    provider: Provider = PairCalculator,
    max_iterations: int = 10_000,
    beam: int | None = 1000,
    greedy: bool = False,
    dropout: float = 0.0,
    seed: int = 0,
    volume: tuple[float, float] | None = None,
    distance: float | None = None,
    ceiling: float | None = None,
    on_result: Callable[[PathResult], None] | None = None,
) -> PathResult:
    """The path from any of starts to any of goals (keys with the same labels).

    heuristic is a name or a function of a key and the list of goals. A point passes if its volume lies strictly between
    the bounds, all distances are above one and its energy is below the ceiling. on_result is called with the result.
    """
    energies = pathfinding.Energies(xi, delta, provider().energy)
    accept = pathfinding.Filters(xi, delta, volume=volume, distance=distance, energy=ceiling, energies=energies)
    found, iterations, path = pathfinding.a_star(starts, goals, labels, delta, heuristic=heuristic, max_iterations=max_iterations, beam=beam, greedy=greedy, dropout=dropout, seed=seed, accept=accept, xi=xi)
    result = PathResult(found, iterations, [list(map(int, k)) for k in path], [float(energies(k)) for k in path])
    if on_result is not None:
        on_result(result)
    return result
