"""What a forest's leaves say about pairs of samples: weights, proximities, errors.

All start from membership(tree, sample_idx, leaf, inbag). Leaves are broadcast, 2 or 4 bytes for each sample and tree, and
each task makes whole rows of weights from them, so that no pair is ever shuffled. Where the leaves take more than LEAF_BYTES,
and for keys that aren't whole numbers, pairs meet in a self-join on (tree, leaf), whose size is the sum of squared leaf sizes;
sums over trees combine before the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructField, StructType
from pyspark.sql.window import Window

from thicket.functions import leafrows
from thicket.functions.stats import principal_scores, spearman
from thicket.operators import matrix
from thicket.sources import checks

#: Bytes of leaves and draws, 4 each for a sample and tree, above which they aren't broadcast.
LEAF_BYTES = 1 << 28
ROWS_AT_ONCE = 1 << 16


def _pairs(m: DataFrame) -> DataFrame:
    a = m.select("tree", "leaf", F.col("sample_idx").alias("i"), F.col("inbag").alias("bi"))
    b = m.select("tree", "leaf", F.col("sample_idx").alias("j"), F.col("inbag").alias("bj"))
    return a.join(b, ["tree", "leaf"])


def _leaf_rows(m: DataFrame, mode: str) -> leafrows.LeafRows | None:
    """The leaves of all samples on the driver; None where they must stay a relation: beyond LEAF_BYTES, or with keys that
    aren't whole numbers, are missing or come twice."""
    kinds = {f.name: f.dataType for f in m.schema}
    small = (ByteType, ShortType, IntegerType)
    if not (isinstance(kinds["tree"], (*small, LongType)) and isinstance(kinds["sample_idx"], (*small, LongType)) and isinstance(kinds["leaf"], small)):
        return None
    drawn = mode != "all"
    if drawn and not isinstance(kinds["inbag"], small):
        return None
    odd = F.col("sample_idx").isNull() | F.col("tree").isNull() | (F.col("inbag").isNull() | (F.col("inbag") < 0) if drawn else F.lit(False))
    trees, rows, wrong = m.agg(F.collect_set("tree"), F.count("*"), F.count(F.when(odd, 1))).first()
    if wrong or not rows or rows * (8 if drawn else 4) > LEAF_BYTES:
        return None
    trees = np.sort(np.array(trees, np.int64))
    fields = [F.col("tree").cast("long").alias("t"), F.coalesce(F.col("leaf").cast("int"), F.lit(leafrows.NO_LEAF)).alias("leaf")] + [F.col("inbag").cast("int").alias("inbag")] * drawn

    def pack(batches):
        for b in batches:
            lists = b.column("r")
            flat = lists.flatten()
            at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            place = np.searchsorted(trees, flat.field("t").to_numpy())
            out = np.full((1 + drawn, len(lists), len(trees)), leafrows.ABSENT, np.int32)
            for k, name in enumerate(("leaf", "inbag")[: 1 + drawn]):
                out[k, at, place] = flat.field(name).to_numpy()
            twice = len(place) > np.count_nonzero(out[0] != leafrows.ABSENT)
            whole = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(lists), -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in whole], pa.binary()), pa.array([twice] * len(lists))], ["id", "r", "twice"])

    packed = m.groupBy(F.col("sample_idx").cast("long").alias("id")).agg(F.collect_list(F.struct(*fields)).alias("r")).mapInArrow(pack, "id long, r binary, twice boolean").toArrow()
    if any(x.as_py() for chunk in packed.column("twice").chunks for x in pa.compute.unique(chunk)):
        return None
    ids = packed.column("id").to_numpy()
    order = np.argsort(ids)
    every = np.concatenate([np.frombuffer(c.buffers()[2], np.int32)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] // 4 :][: len(c) * (1 + drawn) * len(trees)] for c in packed.column("r").chunks if len(c)])
    every = every.reshape(len(ids), 1 + drawn, len(trees))[order]
    return leafrows.LeafRows(every[:, 0].T, np.maximum(every[:, 1].T, 0) if drawn else None, ids[order], mode)


def _rows(m: DataFrame, held: leafrows.LeafRows, top: int | None = None, finish=None) -> DataFrame:
    """(i, j, w): rows of weights, each made whole in a task. finish(i, j, w): w or None, as it goes out."""
    spark = m.sparkSession
    cast = spark.sparkContext.broadcast(held)
    n, cores = held.n, spark.sparkContext.defaultParallelism
    parts = max(cores, min(16 * cores, n // 512))
    runs = min(n, parts)
    kind = m.schema["sample_idx"].dataType
    schema = StructType([StructField("i", kind), StructField("j", kind), StructField("w", StructType.fromDDL("w double")["w"].dataType)])
    number = {ByteType: np.int8, ShortType: np.int16, IntegerType: np.int32, LongType: np.int64}[type(kind)]

    def run(batches):
        full = cast.value.ready()
        ids = full.ids.astype(number)
        for b in batches:
            got, size = [], 0
            for k in b.column("id").to_pylist():
                for p in range(k * n // runs, (k + 1) * n // runs):
                    j, w = full.row(p, top)
                    if finish is not None and len(j):
                        j, w = finish(p, j, w)
                    if len(j):
                        got.append((np.full(len(j), ids[p]), ids[j], w))
                        size += len(j)
                    if size >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], ["i", "j", "w"])
                        got, size = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], ["i", "j", "w"])

    return spark.range(0, runs, 1, runs).mapInArrow(run, schema)


def forest_weights(m: DataFrame, mode: str = "all", top: int | None = None) -> DataFrame:
    """(i, j, w): mean over trees of j's share among the donors of i's leaf. all: every sample is a donor; inbag: by draws;
    oob: by draws, in trees that did not draw i. A row without a tree that counts is absent.

    top: of each row its diagonal and at least what matrix.top_entries keeps of it for this many, ties and all; the rest is
    never written. Only for what is cut to as many entries, or fewer, before any sum."""
    checks.choice(mode, ("all", "inbag", "oob"), "mode")
    if held := _leaf_rows(m, mode):
        return _rows(m, held, top)
    mass: Column = F.lit(1) if mode == "all" else F.col("inbag")
    leaf = Window.partitionBy("tree", "leaf")
    d = m.withColumn("mass", mass.cast("double")).withColumn("total", F.sum("mass").over(leaf))
    donors = d.where("mass > 0").select("tree", "leaf", F.col("sample_idx").alias("j"), (F.col("mass") / F.col("total")).alias("part"))
    queries = d.where("total >= 1" + (" AND inbag = 0" if mode == "oob" else ""))
    trees = queries.groupBy(F.col("sample_idx").alias("i")).agg(F.count("*").alias("trees"))
    sums = queries.select("tree", "leaf", F.col("sample_idx").alias("i")).join(donors, ["tree", "leaf"]).groupBy("i", "j").agg(F.sum("part").alias("s"))
    return sums.join(trees, "i").select("i", "j", (F.col("s") / F.col("trees")).alias("w"))


def adjusted_weights(m: DataFrame, normalised: bool = False, eps: float = 1e-8) -> DataFrame:
    """matrix.adjust of the forest weights, and its normalise_rows if asked for, row by row as they are made."""
    held = _leaf_rows(m, "all")
    if held is None:
        w = matrix.adjust(forest_weights(m), eps=eps)
        return matrix.normalise_rows(w) if normalised else w

    def finish(p, j, w):
        other = j != p
        w = w[other] / max(1 - w[~other].sum(), eps)
        if normalised and len(w):
            total = w.sum()
            return (j[other], w / total) if abs(total) > 1e-12 else (j[:0], w[:0])
        return j[other], w

    return _rows(m, held, finish=finish)


def oob_weights(m: DataFrame) -> DataFrame:
    """The oob weights without their diagonal (an out-of-bag sample is never its own donor)."""
    return forest_weights(m, "oob").where("i <> j")


def ensemble_oob_weights(m: DataFrame) -> DataFrame:
    """Out-of-bag weights over all members of the leaf: 1 / leaf size, over the trees that did not draw i."""
    leaf = Window.partitionBy("tree", "leaf")
    d = m.withColumn("size", F.count("*").over(leaf))
    trees = m.where("inbag = 0").groupBy(F.col("sample_idx").alias("i")).agg(F.count("*").alias("trees"))
    sums = d.where("inbag = 0").select("tree", "leaf", F.col("sample_idx").alias("i"), "size").join(m.select("tree", "leaf", F.col("sample_idx").alias("j")), ["tree", "leaf"])
    return sums.groupBy("i", "j").agg(F.sum(1 / F.col("size")).alias("s")).join(trees, "i").select("i", "j", (F.col("s") / F.col("trees")).alias("w"))


def proximity(m: DataFrame, mode: str = "all") -> DataFrame:
    """(i, j, w): share of trees in which i and j share a leaf; inbag, oob: of the trees in which both are eligible."""
    if mode == "all":
        n = m.select("tree").distinct().agg(F.count("*").alias("n"))
        return _pairs(m).groupBy("i", "j").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("i", "j", (F.col("c") / F.col("n")).alias("w"))
    ok = m.where("inbag > 0" if mode == "inbag" else "inbag = 0")
    a, b = ok.select("tree", F.col("sample_idx").alias("i"), F.col("leaf").alias("x")), ok.select("tree", F.col("sample_idx").alias("j"), F.col("leaf").alias("y"))
    return a.join(b, "tree").groupBy("i", "j").agg(F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("w"))


def sibling_leaves(nodes: DataFrame, m: DataFrame) -> DataFrame:
    """tree, leaf_a, leaf_b: leaves that share a parent. Leaves are numbered from left to right, in the order of the
    leftmost sample path; numbers come from membership joined by the routing order kept in `leaf_number`."""
    inner = nodes.where("NOT is_leaf").select("tree", "left", "right")
    leaves = nodes.where("is_leaf").select("tree", "node", "leaf_number")
    a, b = (leaves.select("tree", F.col("node").alias(s), F.col("leaf_number").alias(n)) for s, n in (("left", "leaf_a"), ("right", "leaf_b")))
    return inner.join(a, ["tree", "left"]).join(b, ["tree", "right"]).select("tree", "leaf_a", "leaf_b")


def enhanced_proximity(m: DataFrame, siblings: DataFrame, gamma: float = 0.5) -> DataFrame:
    """Proximity in which sibling leaves (tree, leaf_a, leaf_b, corr) count least(1, gamma * greatest(corr, 0))."""
    n = m.select("tree").distinct().agg(F.count("*").alias("n"))
    edge = siblings.select("tree", "leaf_a", "leaf_b", F.least(F.lit(1.0), gamma * F.greatest("corr", F.lit(0.0))).alias("part")).where("part > 0")
    one = m.select("tree", F.col("leaf").alias("leaf_a"), F.col("sample_idx").alias("i"))
    other = m.select("tree", F.col("leaf").alias("leaf_b"), F.col("sample_idx").alias("j"))
    cross = one.join(edge, ["tree", "leaf_a"]).join(other, ["tree", "leaf_b"]).select("i", "j", "part")
    every = _pairs(m).select("i", "j", F.lit(1.0).alias("part")).unionByName(cross).unionByName(cross.select(F.col("j").alias("i"), F.col("i").alias("j"), "part"))
    return every.groupBy("i", "j").agg(F.sum("part").alias("s")).crossJoin(F.broadcast(n)).select("i", "j", (F.col("s") / F.col("n")).alias("w"))


def sibling_part(corr: Column, rule: str = "positive", gamma: float = 0.5, capped: bool = True) -> Column:
    """What sibling leaves count for, from the rank correlation of their centroids."""
    f = {"constant": F.lit(1.0), "positive": F.greatest(corr, F.lit(0.0)), "shift01": (corr + 1) / 2, "abs": F.abs(corr), "identity": corr}[rule]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), gamma * f)) if capped else F.greatest(F.lit(0.0), gamma * f)


def leaf_correlations(m: DataFrame, siblings: DataFrame, embeddings: list[np.ndarray]) -> DataFrame:
    """siblings with corr, the mean over embeddings of the rank correlation of the two leaves' centroids.

    Centroids are averages by leaf; the embeddings (samples x some 10) are broadcast, one pass by tree."""
    held = m.sparkSession.sparkContext.broadcast(embeddings)
    leaves = m.groupBy("tree", "leaf").agg(F.collect_list("sample_idx").alias("members"))  # bounded by a leaf's size
    a = siblings.join(leaves.select("tree", F.col("leaf").alias("leaf_a"), F.col("members").alias("xs")), ["tree", "leaf_a"])
    both = a.join(leaves.select("tree", F.col("leaf").alias("leaf_b"), F.col("members").alias("ys")), ["tree", "leaf_b"])

    def run(batches):
        for pdf in batches:
            pdf["corr"] = [float(np.mean([spearman(e[list(x)].mean(0), e[list(y)].mean(0)) for e in held.value])) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pdf[["tree", "leaf_a", "leaf_b", "corr"]]

    return both.select("tree", "leaf_a", "leaf_b", "xs", "ys").mapInPandas(run, "tree int, leaf_a int, leaf_b int, corr double")


def embeddings_of(forest, dims: int = 10) -> list[np.ndarray]:
    return [principal_scores(b, dims) for b in (forest.x, forest.y) if b is not None]


def number_leaves(nodes: DataFrame) -> DataFrame:
    """nodes with leaf_number, 1, 2, .. from left to right, null at inner nodes; one small task for each tree."""
    def run(pdf):
        pdf = pdf.sort_values("node")
        left, right = pdf["left"].tolist(), pdf["right"].tolist()
        out, stack, k = [None] * len(pdf), [0], 0
        while stack:
            n = stack.pop()
            if left[n] < 0:
                k += 1
                out[n] = k
            else:
                stack += [right[n], left[n]]
        return pdf.assign(leaf_number=out)[["tree", "node", "left", "right", "is_leaf", "leaf_number"]]

    return nodes.select("tree", "node", "left", "right", "is_leaf").groupBy("tree").applyInPandas(run, "tree int, node int, left int, right int, is_leaf boolean, leaf_number int")


def enhanced_of(forest, gamma: float = 0.5, dims: int = 10) -> DataFrame:
    pairs = sibling_leaves(number_leaves(forest.nodes), forest.membership)
    return enhanced_proximity(forest.membership, leaf_correlations(forest.membership, pairs, embeddings_of(forest, dims)), gamma)


def nmse(weights: DataFrame, long: DataFrame) -> DataFrame:
    """One number: the mean over all features of squared error of W x, over the sample variance (1e-12 at least)."""
    x = long.select(F.col("sample_idx").alias("j"), "block", "feature", "value")
    predicted = weights.join(x, "j").groupBy("i", "block", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("p"))
    both = predicted.join(long.withColumnRenamed("sample_idx", "i"), ["i", "block", "feature"])
    error = both.groupBy("block", "feature").agg(F.avg(F.pow(F.col("p") - F.col("value"), 2)).alias("e"))
    return _over_variance(error, long)


def _over_variance(error: DataFrame, long: DataFrame) -> DataFrame:
    spread = long.groupBy("block", "feature").agg(F.var_samp("value").alias("v"))
    return error.join(spread, ["block", "feature"]).agg(F.avg(F.col("e") / F.greatest("v", F.lit(1e-12))).alias("nmse"))


def forest_nmse(m: DataFrame, long: DataFrame, mode: str = "all") -> DataFrame:
    """nmse of the forest's weights (mode as in forest_weights) without the weights: of each feature, a task of its own takes
    the means of all leaves, and of each sample the mean over its trees."""
    held = _leaf_rows(m, mode)
    if held is None:
        return nmse(forest_weights(m, mode), long)
    cast = m.sparkSession.sparkContext.broadcast(held)

    def run(table):
        full = cast.value.ready()
        one = table.select(["sample_idx", "value"]).drop_null()
        sample, value = one.column(0).to_numpy(), one.column(1).to_numpy()
        at = np.minimum(np.searchsorted(full.ids, sample), full.n - 1)
        known = full.ids[at] == sample
        at, value = at[known], value[known]
        predicted = full.times(at, value)[at]
        met = full.trees[at] > 0
        if any(full.blank) or len(np.unique(at)) < full.n:  # those whose donors have no value have no prediction
            met &= full.times(at, np.ones(len(at)))[at] > 0
        error = float(np.mean((predicted[met] - value[met]) ** 2)) if met.any() else None
        return pa.table({"block": table.column("block")[:1], "feature": table.column("feature")[:1], "e": pa.array([error], pa.float64())})

    rows = long.select("block", "feature", "sample_idx", F.col("value").cast("double").alias("value"))
    return _over_variance(rows.groupBy("block", "feature").applyInArrow(run, "block string, feature string, e double"), long)


def reconstruction_error(weights: DataFrame, x: DataFrame, y: DataFrame | None = None) -> float:
    """The sum over the sides of the mean error of W times a side's block, each feature's over its sample variance."""
    return sum(nmse(weights, side).first()[0] for side in (x, y) if side is not None)


def co_membership(labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("sample_idx").alias("i"), "cluster"), labels.select(F.col("sample_idx").alias("j"), "cluster")
    return a.join(b, "cluster").select("i", "j", F.lit(1.0).alias("w"))


def route(nodes: DataFrame, long: DataFrame, depth: int) -> DataFrame:
    """tree, sample_idx, node: every sample's leaf, by one join for each level of the trees."""
    at = long.select("sample_idx").distinct().crossJoin(nodes.select("tree").distinct()).withColumn("node", F.lit(0))
    inner = nodes.where("NOT is_leaf").select("tree", "node", "left", "right", "split_var", "split_val")
    values = long.select("sample_idx", F.col("feature_idx").alias("split_var"), "value")
    for _ in range(depth):
        step = at.join(inner, ["tree", "node"], "left").join(values, ["sample_idx", "split_var"], "left")
        at = step.select("tree", "sample_idx", F.when(F.col("left").isNull(), F.col("node")).when(F.col("value") <= F.col("split_val"), F.col("left")).otherwise(F.col("right")).alias("node"))
    return at
