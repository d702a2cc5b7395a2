"""Growing one multivariate tree on numpy arrays, and routing rows through it. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from thicket.functions.rng import Stream

GAIN = 1e-9


@dataclass
class Tree:
    """Nodes in breadth-first order; left and right are -1 at leaves, msrv -1 where there is none."""

    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    var: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    score: list[float] = field(default_factory=list)
    msrv: list[int] = field(default_factory=list)
    stats: list[dict[int, float]] = field(default_factory=list)

    def add(self, depth: int, size: int) -> int:
        for column, value in ((self.left, -1), (self.right, -1), (self.depth, depth), (self.size, size), (self.var, -1), (self.cut, 0.0), (self.score, 0.0), (self.msrv, -1), (self.stats, {})):
            column.append(value)
        return len(self.left) - 1

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of x."""
        left, right, var, cut = map(np.asarray, (self.left, self.right, self.var, self.cut))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(left[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = np.where(x[inner, var[here]] <= cut[here], left[here], right[here])

    def preorder_leaves(self) -> dict[int, int]:
        """1, 2, ... for the leaves, from left to right."""
        out, stack = {}, [0]
        while stack:
            n = stack.pop()
            if self.left[n] < 0:
                out[n] = len(out) + 1
            else:
                stack += [self.right[n], self.left[n]]
        return out


class Picked:
    """Columns of a matrix, read as the matrix itself is: m[rows, columns]; nothing is copied."""

    def __init__(self, whole: np.ndarray, columns: np.ndarray):
        self.whole, self.columns, self.shape = whole, np.asarray(columns), (len(whole), len(columns))

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, at):
        return self.whole[at[0], self.columns[at[1]]]


def standardise(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of y with mean 0 and population sd 1 (0 where they don't vary), and which of them vary."""
    centred = y - y.mean(0)
    sd = np.sqrt((centred**2).mean(0))
    live = sd > 0
    return np.where(live, centred / np.where(live, sd, 1), 0.0), live


def gains(x: np.ndarray, z: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For cuts before the places of sorted x: each column's between-children statistic."""
    sums = np.cumsum(z, 0)[places - 1]
    part = sums**2
    return part / places[:, None] + part / (len(x) - places)[:, None], places


def best_split(x, y, rows, mtry, ytry, nsplit, rng: Stream, x_weight=None, y_weight=None):
    """(var, cut, score, msrv, stats) of the best cut, or None. The first candidate drawn wins ties."""
    draw = lambda n, k, w: rng.without_replacement(range(n), min(k, n)) if w is None else rng.weighted(range(n), w, min(k, n))
    xs, ys = draw(x.shape[1], mtry, x_weight), draw(y.shape[1], ytry, y_weight)
    z, live = standardise(y[np.ix_(rows, ys)])
    best, least, some = None, -1.0, live.sum()
    for var in xs:
        v = x[rows, var]
        order = v.argsort(kind="stable")
        v = v[order]
        places = (v[1:] != v[:-1]).nonzero()[0] + 1
        if not len(places):
            continue
        if 0 < nsplit < len(places):
            places = np.array(sorted(rng.without_replacement(places, nsplit)))
        if not some:
            continue
        part, _ = gains(v, z[order], places)
        for k, s in enumerate((part[:, live].sum(1) / some).tolist()):
            if s - least > GAIN:
                best, least = (var, v, places[k], s, part[k]), s
    if best is None:
        return None
    var, v, place, s, part = best
    return var, float(v[place - 1]), s, ys[int(np.where(live, part, -1).argmax())], dict(zip(ys, part.tolist(), strict=True))


def best_split_unsupervised(x, rows, mtry, ytry, nsplit, rng: np.random.Generator):
    """As best_split; each candidate is judged on ytry of the other columns, and cut halfway between its neighbours."""
    best = None
    for var in rng.permutation(x.shape[1])[:mtry].tolist():
        others = np.delete(np.arange(x.shape[1]), var)
        ys = rng.permutation(others)[:ytry]
        z, live = standardise(x[np.ix_(rows, ys)])
        order = np.argsort(x[rows, var], kind="stable")
        v = x[rows, var][order]
        places = np.flatnonzero(v[1:] != v[:-1]) + 1
        if not len(places) or not live.any():
            continue
        if nsplit > 0 and len(places) > nsplit:
            places = np.sort(rng.choice(places, nsplit, replace=False))
        part, _ = gains(v, z[order], places)
        score = part[:, live].sum(1) / live.sum()
        k = int(score.argmax())
        if score[k] - (best[2] if best else -1.0) > GAIN:
            best = (var, float((v[places[k] - 1] + v[places[k]]) / 2), float(score[k]), -1, {})
    return best


def bag_of(n: int, with_replacement: bool, rng: Stream) -> np.ndarray:
    """Rows drawn, sorted, one entry for each draw."""
    drawn = rng.with_replacement(n) if with_replacement else rng.without_replacement(range(n), max(1, int(np.floor(0.632 * n + 0.5))))
    return np.sort(np.array(drawn))


def grow(x: np.ndarray, bag: np.ndarray, find, nodesize: int, max_depth: int) -> Tree:
    """Breadth-first growth; find(rows) gives the best split of a node's draws."""
    tree, level = Tree(), []
    tree.add(0, len(bag))
    level.append((0, bag))
    while level:
        following = []
        for node, rows in level:
            if len(rows) < 2 * nodesize or (max_depth > 0 and tree.depth[node] >= max_depth):
                continue
            split = find(rows)
            if split is None:
                continue
            goes = x[rows, split[0]] <= split[1]
            if goes.all() or not goes.any():
                continue
            tree.var[node], tree.cut[node], tree.score[node], tree.msrv[node], tree.stats[node] = split
            for side, part in ((tree.left, rows[goes]), (tree.right, rows[~goes])):
                side[node] = tree.add(tree.depth[node] + 1, len(part))
                following.append((side[node], part))
        level = following
    return tree
