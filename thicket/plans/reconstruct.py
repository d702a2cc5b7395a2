"""Reconstruct and cluster in one go, and column-subsampled ensembles over connections."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from thicket.functions import cluster as C
from thicket.operators import forest, fusion, importance
from thicket.operators import matrix as X
from thicket.plans.pipeline import cluster_similarity, dense

SMALL = 500


def reconstruct_and_cluster(weights: DataFrame, scores: DataFrame, n: int, k: int | None = None, method: str = "spectral", model_v: int | None = 10, fused_v: int | None = None, how: str = "average", data: np.ndarray | None = None, gamma: float = 0.1, nearest: int | None = None, **options) -> dict:
    """Fused weights with clusters of them. spectral: of W W^T; pam: of the rebuilt data W X; alternating: shares of the
    models and an embedding in turn, k-medoids on the embedding. weights: (model, i, j, w), scores: (model, response, score)."""
    fused, every = fusion.reconstruct(weights, scores, model_v, fused_v, how, **options)
    out = {"fused": fused, "overall": every}
    if method == "spectral":
        return out | cluster_similarity(dense(X.second_order(every), n), k)
    if method == "pam":
        if data is None:
            raise ValueError("pam takes the blocks' data")
        return out | C.pam_tuned(C.distances(dense(every, n) @ data), [k] if k else range(2, min(9, n - 1) + 1))
    if not k:
        raise ValueError("alternating fusion takes k")
    ready = X.prepare(weights, model_v, ["model"])
    models = sorted(r[0] for r in scores.select("model").distinct().collect())
    got = C.fuse_alternating([dense(ready.where(ready["model"] == m), n) for m in models], k, gamma, q=nearest)
    labels = C.pam(C.distances(got["embedding"]), k)[0]
    return out | got | {"k": k, "labels": labels, "models": models}


def plan_of(q: int, p: int, share_y: float = 0.2, share_x: float = 0.2, small: int = SMALL) -> tuple[bool, float, float]:
    """Whether to fit in full, and the shares of responses and predictors: small sides are taken whole."""
    small_y, small_x = q < small, p < small
    return small_y and small_x, 1.0 if small_y else share_y, 1.0 if small_x else share_x


def fit_connections_subsampled(spark: SparkSession, blocks: dict, pairs, control: forest.Control = forest.Control(), n_sub: int = 15, trees: int = 25, full_trees: int = 300, small: int = SMALL, **options) -> list:
    """For each (response, predictor) a full forest if both blocks are small, else the parts of an ensemble."""
    out = []
    for pair in pairs:
        (y, ynames), (x, xnames) = blocks[pair[0]], blocks[pair[-1]]
        whole, share_y, share_x = plan_of(y.shape[1], x.shape[1], small=small)
        if whole:
            out.append(forest.fit(spark, x, y, replace(control, trees=full_trees), xnames, ynames, response=pair[0], predictor=pair[-1]))
        else:
            out.append(forest.fit_subsampled(spark, x, y, n_sub, share_y, share_x, trees, control=control, **options))
    return out


def ensemble_importance(parts: list[dict], side: str = "split_var") -> DataFrame:
    """var (column of the whole block), imd: summed over the parts and divided by their number; absent columns count 0."""
    rows = []
    for p in parts:
        columns = p["x_columns" if side == "split_var" else "y_columns"]
        spark = p["forest"].nodes.sparkSession
        names = spark.createDataFrame([(i, int(c)) for i, c in enumerate(columns)], "var int, at int")
        one = importance.forest_mean(importance.per_tree(p["forest"].nodes, side), p["forest"].control.trees, names.select("var"))
        rows.append(one.join(names, "var").selectExpr("at AS var", "imd"))
    return forest.average(rows, ["var"], "imd")
