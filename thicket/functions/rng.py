"""The seeded streams of tree growing: a shuffled Park-Miller generator, started from a linear congruential chain."""

from __future__ import annotations

import math

M31 = 2**31 - 1
CELLS = 32
WIDTH = 1 + (M31 - 1) // CELLS
TOP = 1.0 - 1.2e-7


class Stream:
    """Uniform numbers in (0, 1) from a seed; a table of 32 numbers decorrelates neighbours."""

    def __init__(self, seed: int):
        self.now = max(1, abs(seed))
        table = []
        for _ in range(CELLS + 8):
            self.now = self.now * 16807 % M31
            table.append(self.now)
        self.table = table[:7:-1]  # filled from its end, after 8 warm-up steps
        self.out = self.table[0]

    def unit(self) -> float:
        self.now = self.now * 16807 % M31
        cell = self.out // WIDTH
        self.out, self.table[cell] = self.table[cell], self.now
        return min(self.out / M31, TOP)

    def index(self, n: int) -> int:
        return max(0, min(n - 1, math.ceil(self.unit() * n) - 1))

    def without_replacement(self, pool, size: int) -> list[int]:
        """Draws by moving the last of the remaining pool into the place drawn."""
        n, moved, out = len(pool), {}, []  # what lies elsewhere than at first: a large pool isn't copied for a few draws
        now, last, table = self.now, self.out, self.table
        for left in range(n, n - max(1, min(size, n)), -1):
            now = now * 16807 % M31
            cell = last // WIDTH
            last, table[cell] = table[cell], now
            at = math.ceil(min(last / M31, TOP) * left) - 1
            at = 0 if at < 0 else left - 1 if at >= left else at
            out.append(moved.get(at, at))
            moved[at] = moved.pop(left - 1, left - 1)
        self.now, self.out = now, last
        return [pool[k] for k in out]

    def with_replacement(self, n: int) -> list[int]:
        return [self.index(n) for _ in range(n)]

    def weighted(self, pool, weights, size: int) -> list[int]:
        """Sequential draws in proportion to weight; weight 0 is out unless nothing has any."""
        live = [(i, weights[i]) for i in pool if math.isfinite(weights[i]) and weights[i] > 0]
        if not live:
            return self.without_replacement(pool, size)
        out = []
        for _ in range(max(1, min(size, len(live)))):
            goal, run, at = self.unit() * sum(w for _, w in live), 0.0, len(live) - 1
            for k, (_, w) in enumerate(live):
                run += w
                if goal < run:
                    at = k
                    break
            out.append(live.pop(at)[0])
        return out


def seed_chain(seed: int, trees: int) -> tuple[list[int], list[int]]:
    """Seeds of the bootstrap stream and of the split stream of every tree."""
    step = lambda s: (1366 * s + 150889) % 714025
    s, chains = seed % 714025, ([], [])
    for chain in chains:
        for _ in range(trees):
            s = step(step(s))
            while s == 0:
                s = step(step(s))
            chain.append(-s)
    return chains
