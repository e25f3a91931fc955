"""The best few of each query while rows go by in one task."""

from __future__ import annotations

import numpy as np


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """``x`` rounded as SQL does it: halves go away from zero, where numpy's go to the even neighbour."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 10.0**digits


class TopK:
    """For each of ``n`` queries the rows of its ``k`` best values and all that tie with the last of them."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.kept, self.new = None, []
        self.size = 0

    def add(self, query: np.ndarray, value: np.ndarray, *columns: np.ndarray) -> None:
        good = value >= self.least[query]
        if good.any():
            self.new.append([query[good], value[good], *(c[good] for c in columns)])
            self.size += int(good.sum())
            if self.size > 1024 + (len(self.kept[0]) if self.kept else 0):
                self.prune()

    def prune(self) -> None:
        parts = ([self.kept] if self.kept else []) + self.new
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((-columns[1], columns[0]))
        query, value = columns[0][order], columns[1][order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        count = np.diff(np.concatenate((first, [len(query)])))
        full = count >= self.k
        self.least[query[first[full]]] = value[first[full] + self.k - 1]
        good = value >= self.least[query]
        self.kept = [c[order][good] for c in columns]
        self.new, self.size = [], 0

    def columns(self) -> list[np.ndarray] | None:
        self.prune()
        return self.kept
