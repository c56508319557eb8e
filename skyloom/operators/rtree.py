"""A static R-tree over boxes, bulk-loaded by sort-tile-recursive packing and probed a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class RTree:
    def __init__(self, lo: np.ndarray, hi: np.ndarray, fan_out: int = 24):
        """lo, hi: (n, d) corners of the boxes; a point has lo == hi."""
        n, d = lo.shape
        self.fan_out, self.n = fan_out, n
        tile = np.zeros(n, np.int64)
        order = np.arange(n)
        mid = (lo + hi) / 2
        for axis in range(d):  # each pass cuts every tile of the pass before into equal runs along one axis
            order = np.lexsort((mid[:, axis], tile))
            if axis == d - 1:
                break
            runs = max(1, int(np.ceil((n / fan_out) ** (1 / d))))
            sorted_tile = tile[order]
            start = np.r_[0, np.flatnonzero(np.diff(sorted_tile)) + 1] if n else np.zeros(0, int)
            size = np.diff(np.r_[start, n])
            place = np.arange(n) - np.repeat(start, size)
            run = place * runs // np.maximum(np.repeat(size, size), 1)
            new = np.empty(n, np.int64)
            new[order] = sorted_tile * runs + run
            tile = new
        self.order = order
        self.levels = [(lo[order], hi[order])]
        while len(self.levels[-1][0]) > fan_out:
            a, b = self.levels[-1]
            cuts = np.arange(0, len(a), fan_out)
            self.levels.append((np.minimum.reduceat(a, cuts), np.maximum.reduceat(b, cuts)))

    def probe(self, lo: np.ndarray, hi: np.ndarray, block: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query, box) index pairs that intersect, edges included."""
        if not self.n:
            return
        for at in range(0, len(lo), block):
            a, b = lo[at : at + block], hi[at : at + block]
            width = len(self.levels[-1][0])
            q, node = np.repeat(np.arange(len(a)), width), np.tile(np.arange(width), len(a))
            for level in range(len(self.levels) - 1, -1, -1):
                na, nb = self.levels[level]
                hit = ((na[node] <= b[q]) & (nb[node] >= a[q])).all(axis=1)
                q, node = q[hit], node[hit]
                if not len(q):
                    break
                if level:
                    below = len(self.levels[level - 1][0])
                    first = node * self.fan_out
                    count = np.minimum(self.fan_out, below - first)
                    q = np.repeat(q, count)
                    node = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            if len(q):
                yield q + at, self.order[node]
