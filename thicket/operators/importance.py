"""Inverse minimal depth: how near to the roots a feature splits, or is the response a split moves most.

All of it is aggregation over nodes(tree, depth, split_var, msrv)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window


def per_tree(nodes: DataFrame, side: str = "split_var", by=()) -> DataFrame:
    """tree, var, imd: 1 / (least depth + 1) of the variables each tree uses; others are absent and count 0."""
    used = nodes.where(F.col(side).isNotNull() & (F.col(side) >= 0))
    return used.groupBy(*by, "tree", F.col(side).alias("var")).agg((1 / (F.min("depth") + 1)).alias("imd"))


def forest_mean(trees: DataFrame, n_trees: int, variables: DataFrame, by=()) -> DataFrame:
    """var, imd: the mean over all trees, 0 for variables that none uses."""
    sums = trees.groupBy(*by, "var").agg((F.sum("imd") / n_trees).alias("imd"))
    return variables.join(sums, [*by, "var"], "left").fillna(0.0, ["imd"])


def used_mean(trees: DataFrame, by=()) -> DataFrame:
    """var, imd: the mean over the trees that use the variable."""
    return trees.groupBy(*by, "var").agg(F.avg("imd").alias("imd"))


def usage(trees: DataFrame, n_trees: int, by=()) -> DataFrame:
    """var, share: the share of trees that use the variable."""
    return trees.groupBy(*by, "var").agg((F.count("*") / n_trees).alias("share"))


def require_features(imd: DataFrame, features: DataFrame) -> None:
    """Each model's features must be the block's, none more, none less."""
    models = imd.select("model", "block").distinct().join(features, "block")
    odd = models.join(imd, ["model", "block", "feature"], "left_anti").unionByName(imd.select("model", "block", "feature").join(features, ["block", "feature"], "left_anti"))
    for r in odd.limit(1).collect():
        raise ValueError(f"model {r['model']}: feature {r['feature']} of block {r['block']} is missing or unknown")


def block_mean(imd: DataFrame, unit: bool = False) -> DataFrame:
    """block, feature, imd: the mean over the models that a block takes part in; unit: of length 1 in each block."""
    n = imd.groupBy("block").agg(F.count_distinct("model").alias("n"))
    out = imd.groupBy("block", "feature").agg(F.sum("imd").alias("imd")).join(n, "block").select("block", "feature", (F.col("imd") / F.col("n")).alias("imd"))
    if unit:
        length = F.sqrt(F.sum(F.col("imd") * F.col("imd")).over(Window.partitionBy("block")))
        out = out.withColumn("_l", length).withColumn("imd", F.when(F.col("_l") > 0, F.col("imd") / F.col("_l")).otherwise(0.0)).drop("_l")
    return out


def split_statistics(samples: DataFrame) -> DataFrame:
    """node, response, stat from (node, response, side 'L' or 'R', y): between-children statistic of y standardised with
    its sample sd; 0 where y does not vary."""
    s = samples.groupBy("node", "response").agg(
        F.count(F.when(F.col("side") == "L", 1)).alias("nl"), F.count(F.when(F.col("side") == "R", 1)).alias("nr"), F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"),
        F.sum(F.when(F.col("side") == "L", F.col("y"))).alias("sl"),
    )
    z = (F.col("sl") - F.col("nl") * F.col("m")) / F.col("sd")
    ok = (F.col("sd") > 0) & (F.col("nl") > 0) & (F.col("nr") > 0)
    return s.select("node", "response", F.when(ok, z * z / F.col("nl") + z * z / F.col("nr")).otherwise(0.0).alias("stat"))


def node_samples(nodes: DataFrame, m: DataFrame, parents: DataFrame) -> DataFrame:
    """(tree, node, side, sample_idx): the samples that each inner node sends left and right; parents has (tree, node,
    ancestor, side) for each leaf."""
    leaf = m.select("tree", F.col("leaf").alias("leaf_number"), "sample_idx")
    return leaf.join(parents, ["tree", "leaf_number"]).select("tree", F.col("ancestor").alias("node"), "side", "sample_idx")


def leaf_ancestors(nodes: DataFrame) -> DataFrame:
    """(tree, leaf_number, ancestor, side) of all leaves, one small task for each tree."""
    def run(pdf):
        pdf = pdf.sort_values("node")
        left, right = pdf["left"].tolist(), pdf["right"].tolist()
        rows, stack, k = [], [(0, ())], 0
        while stack:
            n, path = stack.pop()
            if left[n] < 0:
                k += 1
                rows += [(int(pdf["tree"].iloc[0]), k, a, s) for a, s in path]
            else:
                stack += [(right[n], (*path, (n, "R"))), (left[n], (*path, (n, "L")))]
        import pandas as pd

        return pd.DataFrame(rows, columns=["tree", "leaf_number", "ancestor", "side"])

    return nodes.select("tree", "node", "left", "right").groupBy("tree").applyInPandas(run, "tree int, leaf_number int, ancestor int, side string")


def largest_responses(left, right, depth, leaf, cluster, sample, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, response, depth of one tree's inner nodes that a cluster's samples reach on both sides: of each cluster the
    response with the largest split_statistics, the first one among equals. Counts, sums and squares (by Chan's merging)
    go up from the leaves level by level, so a sample is read once for each response, not once for each node above it.

    left, right, depth: by node, children behind their parents; leaf (from 1, left to right), cluster, sample: by row."""
    stack, number = [0] if len(left) else [], []
    while stack:
        n = stack.pop()
        if left[n] < 0:
            number.append(n)
        else:
            stack += [int(right[n]), int(left[n])]
    nodes, clusters = len(left), int(cluster.max(initial=-1)) + 1
    inner = np.flatnonzero(left >= 0)
    levels = [inner[depth[inner] == d] for d in range(int(depth.max(initial=0)), -1, -1)]
    key = cluster * nodes + np.array(number, int)[leaf - 1] if len(leaf) else np.zeros(0, int)
    order = np.argsort(key, kind="stable")
    key, sample = key[order], sample[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    count = np.bincount(key, minlength=clusters * nodes).reshape(clusters, nodes)
    for at in levels:
        count[:, at] = count[:, left[at]] + count[:, right[at]]
    nl, nr, all_ = count[:, left[inner]], count[:, right[inner]], count[:, inner]
    top, who = np.zeros((clusters, len(inner))), np.full((clusters, len(inner)), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(y.shape[1] if len(key) else 0):
            v = y[sample, k]
            total, square, low, high = (np.full(clusters * nodes, x) for x in (0.0, 0.0, np.inf, -np.inf))
            own = key[starts]
            total[own], low[own], high[own] = np.add.reduceat(v, starts), np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
            square[own] = np.add.reduceat((v - np.repeat(total[own] / count.ravel()[own], np.diff(np.r_[starts, len(v)]))) ** 2, starts)
            total, square, low, high = (x.reshape(clusters, nodes) for x in (total, square, low, high))
            for at in levels:
                a, b = left[at], right[at]
                na, nb = count[:, a], count[:, b]
                apart = np.where((na > 0) & (nb > 0), (total[:, a] / na - total[:, b] / nb) ** 2 * na * nb / (na + nb), 0.0)
                square[:, at] = square[:, a] + square[:, b] + apart
                total[:, at] = total[:, a] + total[:, b]
                low[:, at], high[:, at] = np.minimum(low[:, a], low[:, b]), np.maximum(high[:, a], high[:, b])
            sd = np.where(high[:, inner] > low[:, inner], np.sqrt(square[:, inner] / (all_ - 1)), 0.0)
            z = (total[:, left[inner]] - nl * (total[:, inner] / all_)) / sd
            stat = np.where((sd > 0) & (nl > 0) & (nr > 0), z * z / nl + z * z / nr, 0.0)
            better = stat > top
            top, who = np.where(better, stat, top), np.where(better, k, who)
    c, at = np.nonzero(who >= 0)
    return c, who[c, at], depth[inner[at]]


def cluster_imd(forest, clusters: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(cluster, side, var, imd) recomputed on each cluster's samples without a refit, and (cluster, samples, status).

    The X side depends on the trees alone. For the Y side a node's response is the one that its split moves most among the
    cluster's samples; nodes that the cluster does not reach on both sides have none."""
    status = clusters.groupBy("cluster").agg(F.count("*").alias("samples")).withColumn("status", F.when(F.col("samples") >= least, "ok").otherwise("too small"))
    ok = clusters.join(status.where("status = 'ok'"), "cluster", "left_semi")
    trees = forest.control.trees
    x = per_tree(forest.nodes).groupBy("var").agg((F.sum("imd") / trees).alias("imd"))
    x_side = ok.select("cluster").distinct().crossJoin(x).select("cluster", F.lit("X").alias("side"), "var", "imd")
    held = clusters.sparkSession.sparkContext.broadcast(np.asfortranarray(forest.y))
    kind = clusters.schema["cluster"].dataType

    def run(nodes, rows):
        n = nodes.sort_by("node")
        left, right, depth = (n.column(c).to_numpy() for c in ("left", "right", "depth"))
        found, cluster = np.unique(rows.column("cluster").to_numpy(zero_copy_only=False), return_inverse=True)
        best = largest_responses(left, right, depth, rows.column("leaf").to_numpy(), cluster, rows.column("sample_idx").to_numpy(), held.value)
        out = {(c, v): d for c, v, d in sorted(zip(*(x.tolist() for x in best), strict=True), reverse=True)}  # the least depth comes last
        keys = list(out)
        names = [pa.array(found)[c].as_py() for c, _ in keys]
        imd = pa.array([1 / (out[k] + 1) for k in keys], pa.float64())
        return pa.table({"cluster": pa.array(names, to_arrow_type(kind)), "var": pa.array([v for _, v in keys], pa.int32()), "imd": imd})

    schema = StructType([StructField("cluster", kind), *StructType.fromDDL("var int, imd double")])
    trees_of = forest.nodes.select("tree", "node", "left", "right", "depth").groupBy("tree")
    samples_of = forest.membership.select(F.col("tree").alias("t"), "sample_idx", "leaf").join(ok.where("cluster IS NOT NULL").select("sample_idx", "cluster"), "sample_idx").groupBy("t")
    y_side = trees_of.cogroup(samples_of).applyInArrow(run, schema).groupBy("cluster", "var").agg((F.sum("imd") / trees).alias("imd"))
    return x_side.unionByName(y_side.select("cluster", F.lit("Y").alias("side"), "var", "imd")), status


def path_importance(forest, clusters: DataFrame, unit: bool = True) -> DataFrame:
    """(cluster, side, var, imd): the mean score of the splits that a cluster's samples pass on their ways to their leaves.

    Every passing of a sample through a node counts once: on the X side with the node's score for its split feature, on the
    Y side with the node's statistic of each response that is above 0. unit: each side is scaled to a length of 1. Features
    that a cluster never meets are absent. Samples without a cluster count for none."""
    visits = node_samples(forest.nodes, forest.membership, leaf_ancestors(forest.nodes)).join(clusters.where("cluster IS NOT NULL"), "sample_idx")
    passed = visits.groupBy("cluster", "tree", "node").agg(F.count("*").alias("times"))
    nodes = forest.nodes.where("NOT is_leaf").select("tree", "node", "split_var", "score", "y_stats")
    at = passed.join(nodes, ["tree", "node"])
    x = at.select("cluster", F.lit("X").alias("side"), F.col("split_var").alias("var"), F.col("score").alias("s"), "times")
    y = at.select("cluster", F.lit("Y").alias("side"), "times", F.explode("y_stats").alias("var", "s")).where("s > 0").select("cluster", "side", "var", "s", "times")
    out = x.unionByName(y).groupBy("cluster", "side", "var").agg((F.sum(F.col("s") * F.col("times")) / F.sum("times")).alias("imd"))
    if not unit:
        return out
    length = F.sqrt(F.sum(F.col("imd") * F.col("imd")).over(Window.partitionBy("cluster", "side")))
    return out.withColumn("length", length).withColumn("imd", F.when(F.col("length") > 0, F.col("imd") / F.col("length")).otherwise(F.col("imd"))).drop("length")


def largest_by_feature(rows: DataFrame, features: DataFrame) -> DataFrame:
    """feature, imd: the largest finite importance among a feature's rows, 0 without any; rows of no known feature go."""
    known = rows.where("imd IS NOT NULL AND NOT isnan(imd) AND abs(imd) < double('infinity')").groupBy("feature").agg(F.max("imd").alias("imd"))
    return features.select("feature").distinct().join(known, "feature", "left").fillna(0.0, ["imd"])


def discounted(imd: DataFrame, counts: DataFrame, factor: float) -> DataFrame:
    """imd (block, feature, imd), times factor for features that split once only; counts: (block, feature, times)."""
    once = counts.where("times = 1").select("block", "feature", F.lit(True).alias("_once"))
    return imd.join(once, ["block", "feature"], "left").withColumn("imd", F.when(F.col("_once"), F.col("imd") * F.lit(float(factor))).otherwise(F.col("imd"))).drop("_once")


def pairwise(nodes: DataFrame, n_trees: int) -> DataFrame:
    """var, msrv, w: each split adds 1 / (depth + 1) to its pair; by tree."""
    return nodes.where("split_var >= 0 AND msrv IS NOT NULL").groupBy(F.col("split_var").alias("var"), "msrv").agg((F.sum(1 / (F.col("depth") + 1)) / n_trees).alias("w"))


def adjacency(pairs: DataFrame, scaled: bool = False) -> DataFrame:
    """f1, f2, w of (block1, f1, block2, f2, w) pairs of all models: symmetric, without loops, divided by the number of
    models of the two blocks; scaled: D^-1/2 A D^-1/2."""
    n = pairs.select("model", F.least("block1", "block2").alias("b1"), F.greatest("block1", "block2").alias("b2")).distinct().groupBy("b1", "b2").agg(F.count("*").alias("n"))
    one = pairs.select("block1", "f1", "block2", "f2", "w")
    both = one.unionByName(one.select(F.col("block2").alias("block1"), F.col("f2").alias("f1"), F.col("block1").alias("block2"), F.col("f1").alias("f2"), "w"))
    sums = both.where("NOT (block1 = block2 AND f1 = f2)").groupBy("block1", "f1", "block2", "f2").agg(F.sum("w").alias("w"))
    out = sums.withColumns({"b1": F.least("block1", "block2"), "b2": F.greatest("block1", "block2")}).join(n, ["b1", "b2"]).select("block1", "f1", "block2", "f2", (F.col("w") / F.col("n")).alias("w"))
    if scaled:
        d = out.groupBy("block1", "f1").agg(F.sum("w").alias("d"))
        e = d.select(F.col("block1").alias("block2"), F.col("f1").alias("f2"), F.col("d").alias("e"))
        out = out.join(d, ["block1", "f1"]).join(e, ["block2", "f2"]).select("block1", "f1", "block2", "f2", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))
    return out


def edges_of_trees(nodes: DataFrame) -> DataFrame:
    """tree, from, to, inv_depth, share: parent and child, 1 / the child's depth, the child's share of its parent."""
    p = nodes.where("NOT is_leaf").select("tree", F.col("node").alias("from"), F.col("nodesize").alias("whole"), F.explode(F.array("left", "right")).alias("to"))
    c = nodes.select("tree", F.col("node").alias("to"), "depth", "nodesize")
    return p.join(c, ["tree", "to"]).select("tree", "from", "to", (1 / F.col("depth")).alias("inv_depth"), (F.col("nodesize") / F.col("whole")).alias("share"))
