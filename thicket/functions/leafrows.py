"""Rows of leaf weights from the leaves of all samples, on numpy arrays. No Spark here."""

from __future__ import annotations

import numpy as np

ABSENT, NO_LEAF = -(2**31), -(2**31) + 1  # no row of the sample in the tree; a row without a leaf, which meets none


class LeafRows:
    """leaves (trees x samples), draws alike or None, ids of the samples.

    mode: all, inbag, oob as leaves.forest_weights. What travels are codes (leaves from 0 on, -1 where a sample has none)
    and draws; the members of each leaf are sorted when they are first asked for."""

    def __init__(self, leaves: np.ndarray, draws: np.ndarray | None, ids: np.ndarray, mode: str):
        self.ids, self.mode, self.n, self.members = ids, mode, leaves.shape[1], None
        self.codes, self.sizes, self.blank = np.full(leaves.shape, -1, np.int32), [], []
        for t, row in enumerate(leaves):
            there = row != ABSENT
            found, self.codes[t, there] = np.unique(row[there], return_inverse=True)
            self.sizes.append(len(found))
            self.blank.append(len(found) > 0 and found[0] == NO_LEAF)
        if max(self.sizes) < 32767:
            self.codes = self.codes.astype(np.int16)
        self.draws = draws if draws is None or draws.max(initial=0) > 32767 else draws.astype(np.int16)

    def ready(self) -> LeafRows:
        if self.members is not None:
            return self
        by_draws = self.mode != "all"
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.asks = np.zeros(self.codes.shape, bool)
        members, first, past, mass, at = [], [], [], [], 0
        for t, code in enumerate(self.codes):
            there = code >= 0
            gives = there & (self.draws[t] > 0) if by_draws else there
            total = np.bincount(code[gives], self.draws[t][gives] if by_draws else None, minlength=self.sizes[t]).astype(float)
            self.asks[t, there] = total[code[there]] >= 1
            if self.mode == "oob":
                self.asks[t] &= self.draws[t] == 0
            order = np.argsort(code, kind="stable").astype(np.int32)
            order = order[gives[order]]
            bounds = np.searchsorted(code[order], np.arange(self.sizes[t] + 1)) + at
            first.append(bounds[:-1].copy())
            past.append(bounds[1:].copy())
            if self.blank[t]:
                past[t][0] = first[t][0]
            members.append(order)
            mass.append(np.maximum(total, 1))
            at += len(order)
        self.trees = self.asks.sum(0)
        self.first, self.past, self.mass = map(np.concatenate, (first, past, mass))
        self.members = np.concatenate(members)
        self.weight = None  # of each member, where one was drawn more than once
        if by_draws and self.draws.max(initial=0) > 1:
            self.weight = np.concatenate([self.draws[t][x] for t, x in enumerate(members)])
        return self

    def sums(self, p: int) -> np.ndarray:
        """Of row p: every sample's parts, summed over the trees in their order."""
        trees = np.flatnonzero(self.asks[:, p])
        leaf = self.base[trees] + self.codes[trees, p]
        a, b = self.first[leaf], self.past[leaf]
        if not (b > a).any():
            return np.zeros(self.n)
        spans = [slice(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        parts = np.repeat(self.mass[leaf], b - a)
        parts = np.divide(1.0 if self.weight is None else np.concatenate([self.weight[s] for s in spans]), parts, out=parts)
        return np.bincount(np.concatenate([self.members[s] for s in spans]), parts, minlength=self.n)

    def row(self, p: int, top: int | None = None, slack: float = 2e-12) -> tuple[np.ndarray, np.ndarray]:
        """Samples and weights of row p. top: its own entry, and all that are not below the top-th largest of the others by
        more than slack, so that weights can still be rounded before they are ranked."""
        trees = self.trees[p]
        if not trees:
            return np.zeros(0, int), np.zeros(0)
        s = self.sums(p)
        if top is None:
            keep = np.flatnonzero(s)
            return keep, s[keep] / trees
        own, s[p] = s[p], 0.0
        few, low = s[::16], 0.0
        if len(few) > 4 * top:
            low = np.partition(few, -top)[-top] - slack * trees
        keep = np.flatnonzero(s >= low) if low > 0 else np.flatnonzero(s)
        if len(keep) > top:
            values = s[keep]
            keep = keep[values >= np.partition(values, -top)[-top] - slack * trees]
        w = s[keep] / trees
        return (np.append(keep, p), np.append(w, own / trees)) if own > 0 else (keep, w)

    def times(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of all samples: weights times one feature that is given at some; nan where a sample has no tree. A pass over trees."""
        x, out, k = np.bincount(at, values, minlength=self.n), np.zeros(self.n), 0
        for t, code in enumerate(self.codes):
            lo, hi = self.base[t], self.base[t + 1]
            size = int(np.count_nonzero(code >= 0)) if self.mode == "all" else int(np.count_nonzero((code >= 0) & (self.draws[t] > 0)))
            members = self.members[k : k + size]
            given = x[members] if self.weight is None else x[members] * self.weight[k : k + size]
            mean = np.bincount(code[members], given, minlength=hi - lo) / self.mass[lo:hi]
            if self.blank[t]:
                mean[0] = 0
            asks = self.asks[t]
            out[asks] += mean[code[asks]]
            k += size
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.trees > 0, out / self.trees, np.nan)
