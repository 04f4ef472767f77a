"""Centred moments that can be merged: n, means and co-moments of columns, without sums of squares that cancel.

A state's means are relative to its origin, one of its own rows, so neither a large offset of a column nor rows that have
left a window cost digits. States are merged pairwise; nothing is ever subtracted from a state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Moments:
    """n rows of columns: origin + mean is their mean, comoment the sum of products of deviations from it."""

    n: float
    origin: np.ndarray
    mean: np.ndarray
    comoment: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        away = rows - rows[0]
        mean = away.mean(0)
        # Equal values deviate by exactly nothing.
        away = np.where((away == away[0]).all(0), 0.0, away - mean)
        return cls(float(len(rows)), rows[0], mean, away.T @ away)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = (other.origin - self.origin) + (other.mean - self.mean)
        return Moments(n, self.origin, self.mean + apart * (other.n / n), self.comoment + other.comoment + np.outer(apart, apart) * (self.n * other.n / n))

    def pack(self) -> np.ndarray:
        return np.concatenate([[self.n], self.origin, self.mean, self.comoment.ravel()])

    @classmethod
    def unpack(cls, values: np.ndarray, width: int) -> Moments:
        return cls(values[0], values[1 : width + 1], values[width + 1 : 2 * width + 1], values[2 * width + 1 :].reshape(width, width))

    def ridge(self, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(weights, centre, value): the last column is value + weights . (x - centre) of the others, as ``learners.ridge`` fits it."""
        spread = np.diag(self.comoment)[:-1] / self.n
        scale = np.sqrt(np.where(spread > 0, spread, 1.0))
        system = self.comoment[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(scale))
        weights = np.linalg.solve(system, self.comoment[:-1, -1] / scale) / scale
        return weights, self.origin[:-1], float(self.origin[-1] + self.mean[-1] - weights @ self.mean[:-1])


def windows(states: Iterable[tuple[int, int, Moments]], steps: range) -> Iterator[tuple[int, Moments | None]]:
    """The merged states alive at each step: (begin, end, state) lives from step begin to step end; begins and ends ascend.

    Two stacks: what comes is merged onto the back; when the front has run out, the back is turned over, so that the front's
    top is always the merged rest of it. A state is merged at most three times, however long it lives.
    """
    queue = iter(states)
    coming = next(queue, None)
    front: list[tuple[int, Moments]] = []  # (end, itself and all younger ones of the front, merged)
    back: list[tuple[int, Moments]] = []
    total: Moments | None = None  # of the back
    for step in steps:
        while coming and coming[0] <= step:
            back.append(coming[1:])
            total = total + coming[2] if total else coming[2]
            coming = next(queue, None)
        while front and front[-1][0] < step:
            front.pop()
        if not front and back and back[0][0] < step:
            for end, state in reversed(back):
                front.append((end, state + front[-1][1] if front else state))
            back, total = [], None
            while front and front[-1][0] < step:
                front.pop()
        older = front[-1][1] if front else None
        yield step, older + total if older and total else older or total
