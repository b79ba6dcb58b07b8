"""Paths of crystals as text of a trajectory file: a header, then one frame per step with its own cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def text(cells: Sequence, fractions: Sequence, elements: Sequence[str], title: str = "path") -> str:
    """Frames in the variable-cell form of XDATCAR; atoms of one element must stand together, else ValueError."""
    names = list(dict.fromkeys(elements))
    if sorted(elements, key=names.index) != list(elements):
        raise ValueError("atoms of one element must stand together")
    counts = "  ".join(str(list(elements).count(n)) for n in names)
    lines: list[str] = []
    for k, (cell, at) in enumerate(zip(cells, fractions), 1):
        lines += [title, "1.0", *(" ".join(f"{x:.10f}" for x in row) for row in np.asarray(cell)), "  ".join(names), counts, f"Direct configuration= {k:5d}"]
        lines += [" ".join(f"{x:.10f}" for x in row) for row in np.asarray(at) % 1]
    return "\n".join(lines) + "\n"


def parse(content: str) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """Cells, fractions and elements of such a text."""
    lines, cells, fractions, elements, at = content.splitlines(), [], [], [], 0
    while at < len(lines):
        scale = float(lines[at + 1])
        cells.append(scale * np.array([[float(x) for x in line.split()] for line in lines[at + 2 : at + 5]]))
        counts = [int(x) for x in lines[at + 6].split()]
        elements = [n for n, c in zip(lines[at + 5].split(), counts) for _ in range(c)]
        n = sum(counts)
        fractions.append(np.array([[float(x) for x in line.split()[:3]] for line in lines[at + 8 : at + 8 + n]]))
        at += 8 + n
    return cells, fractions, elements
