"""Merging sibling leaves of grown trees, as a harder form of enhanced proximity.

A pair of sibling leaves is merged if its centroids agree less than an earlier merge of either did (or that was negative)
and the smaller leaf has more than `least` samples; of several candidates in a tree, those at or above a quantile of their
correlation. Rounds go on until no tree changes. A tree is small (its leaves and their centroids), so a task takes whole
trees and trees are dealt out freely."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.stats import quantile, spearman


def merge_tree(left: list[int], right: list[int], leaf: np.ndarray, number: dict[int, int], embeddings: list[np.ndarray], q: float = 0.9, least: int = 10) -> np.ndarray:
    """Leaf labels of the samples after merging. left, right: children by node (-1 at leaves); number: label of each leaf."""
    label, label_of, best = leaf.copy(), dict(number), {}
    open_ = {n for n in label_of}
    while True:
        pairs = []
        for p in range(len(left)):
            a, b = left[p], right[p]
            if a in open_ and b in open_:
                x, y = label == label_of[a], label == label_of[b]
                if x.any() and y.any() and label_of[a] != label_of[b]:
                    corr = float(np.mean([spearman(e[x].mean(0), e[y].mean(0)) for e in embeddings]))
                    before = max(best.get(a, 0.0), best.get(b, 0.0))
                    if (corr < before or before < 0) and min(x.sum(), y.sum()) > least:
                        pairs.append((corr, p))
        if not pairs:
            return label
        limit = quantile([c for c, _ in pairs], min(max(q, 0.0), 1.0), 8) if len(pairs) > 1 else pairs[0][0]
        for corr, p in pairs:
            if corr >= limit:
                a, b = left[p], right[p]
                keep = max(label_of[a], label_of[b])
                label[np.isin(label, [label_of[a], label_of[b]])] = keep
                label_of[p], best[p] = keep, corr
                open_ -= {a, b}
                open_.add(p)


def merged_membership(forest, embeddings: list[np.ndarray], q: float = 0.9, least: int = 10) -> DataFrame:
    """membership of the forest with siblings merged."""
    held = forest.nodes.sparkSession.sparkContext.broadcast(embeddings)
    rows = forest.membership.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "leaf", "inbag"))).alias("m"))
    nodes = forest.nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("node", "left", "right"))).alias("t"))
    both = rows.join(nodes, "tree").select("tree", "m.sample_idx", "m.leaf", "m.inbag", "t.left", "t.right")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                left, right = list(r.left), list(r.right)
                number, stack = {}, [0]
                while stack:
                    n = stack.pop()
                    if left[n] < 0:
                        number[n] = len(number) + 1
                    else:
                        stack += [right[n], left[n]]
                label = merge_tree(left, right, np.array(r.leaf), number, held.value, q, least)
                yield pd.DataFrame({"tree": r.tree, "sample_idx": r.sample_idx, "leaf": label, "inbag": r.inbag})

    return both.mapInPandas(run, "tree int, sample_idx int, leaf int, inbag int")
