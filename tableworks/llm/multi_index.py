"""An inverted multi-index: two codebooks, one for each half of the space, whose pairs are cells.

The score of a row with a query is at most the score of its half codes plus, for each half, the length of the
query's half times the radius of the code (the largest distance of a row from it). A heap over the two sorted
lists of half bounds gives the cells in falling order of that sum, so a search may stop where no row of a
later cell could enter its result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rounds of k-means.
ROUNDS = 8


def _nearest(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row and its squared distance; ties go to the first code."""
    far = (codes ** 2).sum(1) - 2 * (rows @ codes.T)
    best = far.argmin(1)
    return best, ((rows - codes[best]) ** 2).sum(1)


def fit_codes(rows: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` codes of the rows by k-means, from rows at equal steps; one code at the origin without rows."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    codes = np.unique(rows[np.linspace(0, len(rows) - 1, count).astype(int)].astype(np.float64), axis=0)
    for _ in range(ROUNDS):
        best, _ = _nearest(rows, codes)
        held = np.bincount(best, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, best, rows)
        codes = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], codes)
    return codes


@dataclass
class Index:
    """Codebooks of the two halves, and by cell what the rows have: number, first block and number of blocks."""

    left: np.ndarray
    right: np.ndarray
    left_radius: np.ndarray | None = None
    right_radius: np.ndarray | None = None
    count: np.ndarray | None = None
    block: np.ndarray | None = None
    parts: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and squared distances of both halves from their codes."""
        i, a = _nearest(rows[:, :self.half], self.left)
        j, b = _nearest(rows[:, self.half:], self.right)
        return i * len(self.right) + j, a, b

    def fill(self, cells: list[tuple[int, int, float, float]], most: int) -> int:
        """Takes (cell, rows, largest squared distances); gives the number of blocks.

        Neighbouring cells share a block of at most ``most`` rows; a larger cell has several of its own.
        """
        size, wide = len(self.left) * len(self.right), len(self.right)
        self.left_radius, self.right_radius = np.zeros(len(self.left)), np.zeros(wide)
        self.count, self.block, self.parts = (np.zeros(size, np.int64) for _ in range(3))
        at, room = -1, 0
        for cell, rows, a, b in sorted(cells):
            i, j = divmod(cell, wide)
            self.left_radius[i] = max(self.left_radius[i], np.sqrt(a))
            self.right_radius[j] = max(self.right_radius[j], np.sqrt(b))
            if rows > room:
                at, room = at + 1, max(most, rows)
            self.count[cell], self.block[cell], self.parts[cell] = rows, at, max(1, -(-rows // most))
            room -= rows
            if rows > most:
                at, room = at + self.parts[cell] - 1, 0
        return at + 1

    def cells(self, query: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """Cells that hold rows, with bounds from above (falling) and from below on the scores of their rows."""
        one, two = self.left @ query[:self.half], self.right @ query[self.half:]
        wide_one = np.linalg.norm(query[:self.half]) * self.left_radius
        wide_two = np.linalg.norm(query[self.half:]) * self.right_radius
        upper_one, upper_two = one + wide_one, two + wide_two
        first, second = np.argsort(-upper_one, kind="stable"), np.argsort(-upper_two, kind="stable")
        heads, tails = upper_one[first].tolist(), upper_two[second].tolist()
        slack = 1e-6 * (1 + abs(heads[0]) + abs(tails[0]) + np.abs(one).max() + np.abs(two).max())
        heap = [(-heads[0] - tails[0], 0, 0)]
        count, wide = self.count, len(self.right)
        while heap:
            bound, p, q = heapq.heappop(heap)
            if p + 1 < len(heads) and q == 0:
                heapq.heappush(heap, (-heads[p + 1] - tails[0], p + 1, 0))
            if q + 1 < len(tails):
                heapq.heappush(heap, (-heads[p] - tails[q + 1], p, q + 1))
            i, j = int(first[p]), int(second[q])
            if count[i * wide + j]:
                lower = one[i] - wide_one[i] + two[j] - wide_two[j]
                yield i * wide + j, slack - bound, float(lower) - slack
