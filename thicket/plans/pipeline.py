"""The staged pipeline: filter, scale, forests, fusion, residuals, clusters, importance, selection.

Samples x samples matrices are relations until the clustering of one matrix, which takes some thousand samples (SAMPLES)
to the driver; every stage's tables are DataFrames of the result."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import cluster as C
from thicket.functions.tsne import tsne
from thicket.operators import filtering, forest, fusion, importance, leaves, metrics, reports, selection, tuning
from thicket.operators import matrix as M
from thicket.plans.session import cut
from thicket.sources import blocks as B
from thicket.sources import checks

SAMPLES = 10_000


def dense(w: DataFrame, n: int) -> np.ndarray:
    """A (i, j, w) matrix of n samples on the driver."""
    if n > SAMPLES:
        raise ValueError(f"{n} samples: a dense matrix of more than {SAMPLES} is not taken to the driver")
    got = w.select("i", "j", "w").toPandas()
    out = np.zeros((n, n))
    out[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["w"].to_numpy(float)
    return out


def cluster_similarity(s: np.ndarray, k: int | None = None, method: str = "spectral", **options) -> dict:
    s = s.copy()
    np.fill_diagonal(s, 0)
    ks = [k] if k else range(2, min(12, len(s) - 1) + 1)
    return C.spectral(s, ks, **options) if method == "spectral" else C.pam_tuned(np.maximum(1 - s, 0), ks, **options)


def cluster_proximity(proximities: list[DataFrame], n: int, k: int | None = None, method: str = "pam", sparse: bool = False) -> dict:
    """Clusters of the summed proximities, divided by the first diagonal entry; sparse: entries below the density's mode
    become 0."""
    total = proximities[0]
    for p in proximities[1:]:
        total = total.unionByName(p)
    p = dense(total.groupBy("i", "j").agg(F.sum("w").alias("w")), n)
    p /= p[0, 0] or 1.0
    if sparse:
        from thicket.functions.stats import density_mode

        p[p < density_mode(p[np.triu_indices(n, 1)])] = 0
    return cluster_similarity(p, k, method)


@dataclass
class Fit:
    """All tables of a fit; what a stage did not make is None or empty."""

    spark: SparkSession
    config: dict
    long: DataFrame
    samples: list
    pairs: list
    models: list = field(default_factory=list)
    filter_summary: DataFrame | None = None
    scores: DataFrame | None = None
    oob_error: float | None = None
    model_v: int | None = None
    fused_v: int | None = None
    fused: DataFrame | None = None
    overall: DataFrame | None = None
    residual: DataFrame | None = None
    shared_fraction: DataFrame | None = None
    own_models: dict = field(default_factory=dict)
    own_weights: dict = field(default_factory=dict)
    clusters: dict = field(default_factory=dict)
    robust_clusters: dict = field(default_factory=dict)
    imd: DataFrame | None = None
    selected: DataFrame | None = None

    def get_clusters(self, which: str = "main", block: str | None = None):
        found = self.clusters if which == "main" else self.robust_clusters
        return found if block is None else found[block]

    def get_weights(self):
        return self.imd

    def get_selected_vars(self):
        return None if self.selected is None else self.selected.where("selected").select("block", "feature")

    def get_data(self, which: str = "filtered"):
        return self.long if which == "filtered" else self.long.join(self.get_selected_vars(), ["block", "feature"], "left_semi")

    def get_connection(self):
        return list(self.pairs)

    def get_models(self):
        return list(self.models)

    def get_top_vars(self, n: int = 20):
        return reports.top_features(self.imd, n)

    def get_vs_summary(self):
        return selection.summary(self.selected)

    def tidy_shared(self) -> DataFrame:
        """block, shared_frac; no rows before the fusion."""
        if self.shared_fraction is None:
            return self.spark.createDataFrame([], "block string, shared_frac double")
        return self.shared_fraction.orderBy("block")

    def own_importance(self, unit: bool = False) -> DataFrame:
        """block, feature, imd of the blocks' own forests, each on what the other blocks don't share with it."""
        out = None
        for block, m in self.own_models.items():
            features = self.spark.createDataFrame(list(enumerate(m.x_names)), "var int, feature string")
            rows = importance.forest_mean(importance.per_tree(m.nodes), m.control.trees, features).select(F.lit(block).alias("model"), F.lit(block).alias("block"), "feature", "imd")
            out = rows if out is None else out.unionByName(rows)
        return importance.block_mean(out, unit)

    def tidy_clusters(self) -> DataFrame:
        return reports.tidy_clusters({b: reports.labels_frame(self.spark, self.samples, c["labels"]) for b, c in self.clusters.items()})

    def summary(self) -> dict:
        return {
            "samples": len(self.samples), "connections": [list(p) for p in self.pairs], "trees": self.config["trees"], "oob_error": self.oob_error, "model_v": self.model_v, "fused_v": self.fused_v,
            "k": {b: c["k"] for b, c in self.clusters.items()}, "selected": None if self.selected is None else self.get_vs_summary().collect(),
        }


def start(spark: SparkSession, long: DataFrame, trees: int = 300, scale: bool = True, connections=None, filter_mode: str = "auto", score: str = "mad", top=None, control: forest.Control | None = None, select: bool = False, oob: bool = False) -> Fit:
    """Stage one: filter, scale, all directed forests in one job, their modularity and out-of-bag error."""
    names = [r[0] for r in long.select("block").distinct().orderBy("block").collect()]
    samples = [r[0] for r in long.select("sample_idx").distinct().orderBy("sample_idx").collect()]
    tops = {b: filtering.top_of(b, k, len(samples), filter_mode, top if filter_mode == "auto" else None, top) for k, b in enumerate(names)}
    kept, summary = filtering.filter_blocks(long, tops, score)
    if scale:
        kept = filtering.zscore(kept)
    kept = cut(kept)
    data = {b: B.to_matrix(kept.where(F.col("block") == b)) for b in names}
    pairs = B.named_connections(connections, names) if connections else B.ordered_pairs(names)
    control = replace(control or forest.Control(), trees=trees)
    models = forest.fit_connections(spark, {b: (m, f) for b, (m, _, f) in data.items()}, pairs, control, samples)
    fit = Fit(spark, {"trees": trees}, kept, samples, pairs, models, summary)
    rows = []
    errors = []
    for p, m in zip(pairs, models, strict=True):
        w = dense(leaves.forest_weights(m.membership), len(samples))
        e = None
        if oob or select:
            x = kept.where(F.col("block").isin(list(set(p))))
            index = spark.createDataFrame([(s, k) for k, s in enumerate(samples)], "sample_idx long, at int")
            x = x.join(index, "sample_idx").withColumn("sample_idx", F.col("at")).drop("at")
            e = leaves.forest_nmse(m.membership, x, "oob").first()[0]
            errors.append(e)
        rows.append(("_".join(p), p[0], p[-1], C.weight_modularity(w, control.seed), e))
    fit.scores = spark.createDataFrame(rows, "model string, response string, predictor string, quality double, nmse double")
    if select:
        keep = {r["model"] for r in fusion.rank_connections(fit.scores).where("selected").collect()}
        at = [k for k, p in enumerate(pairs) if "_".join(p) in keep]
        fit.pairs, fit.models = [pairs[k] for k in at], [models[k] for k in at]
        fit.scores = fit.scores.where(F.col("model").isin(list(keep)))
    fit.oob_error = float(np.mean(errors)) if errors else None
    return fit


def model_weights(fit: Fit) -> DataFrame:
    out = None
    for p, m in zip(fit.pairs, fit.models, strict=True):
        w = leaves.forest_weights(m.membership).withColumn("model", F.lit("_".join(p)))
        out = w if out is None else out.unionByName(w)
    return cut(out)


def run(spark: SparkSession, long: DataFrame, k: int | dict | None = None, trees: int = 300, model_v: int | str | None = "elbow", fused_v: int | None = None, how: str = "average", main: str = "similarity", run_imd: bool = False, select_rule: str | None = None, robust: bool = False, seed: int = 529, adaptive_options: dict | None = None, **options) -> Fit:
    """All stages. model_v: a number, None (keep all), 'elbow' or 'neff'; main: similarity, proximity or enhanced;
    k: one number for all, or one for 'shared' and for each block, tuned where it is absent; select_rule: t, mixture, threshold
    or adaptive."""
    control = replace(options.pop("control", None) or forest.Control(), seed=seed)
    fit = start(spark, long, trees, control=control, **options)
    n = len(fit.samples)
    weights = model_weights(fit)
    scores = fit.scores.select("model", "response", F.col("quality").alias("score"))
    if model_v == "elbow":
        model_v = tuning.tune_model_top(weights, scores, n)["v"]
    elif model_v == "neff":
        v = M.effective_top(M.adjust(weights), n)
        model_v = None if tuning.no_cut(v, n, floor=True) else v
    fit.model_v, fit.fused_v = (None if tuning.no_cut(model_v, n) else model_v), fused_v
    fused, every = fusion.reconstruct(weights, scores, fit.model_v, fused_v, how)
    fit.fused, fit.overall = cut(fused), cut(every)
    index = spark.createDataFrame([(s, i) for i, s in enumerate(fit.samples)], "sample_idx long, at int")
    placed = fit.long.join(F.broadcast(index), "sample_idx").withColumn("sample_idx", F.col("at")).drop("at")
    answering = [p[0] for p in fit.pairs]
    ks = checks.per_block(k, ["shared", *answering])
    fit.residual = cut(fusion.residual(placed.where(F.col("block").isin(answering)), fit.fused))
    fit.shared_fraction = fusion.shared_fraction(placed, fit.residual)
    if main == "similarity":
        fit.clusters["shared"] = cluster_similarity(dense(M.second_order(fit.overall), n), ks["shared"])
    else:
        prox = [leaves.enhanced_of(m) if main == "enhanced" else leaves.proximity(m.membership) for m in fit.models]
        fit.clusters["shared"] = cluster_proximity(prox, n, ks["shared"])
    for block in dict.fromkeys(answering):
        m, _, names = B.to_matrix(fit.residual.where(F.col("block") == block))
        own = forest.fit(spark, m, None, replace(control, trees=trees), names, samples=fit.samples, response=block, predictor=block)
        fit.own_models[block] = own
        fit.own_weights[block] = cut(M.prepare(leaves.forest_weights(own.membership), fit.model_v))
        s = M.second_order(fit.own_weights[block]) if main == "similarity" else leaves.proximity(own.membership)
        fit.clusters[block] = cluster_similarity(dense(s, n), ks[block], "spectral" if main == "similarity" else "pam")
    if run_imd or select_rule:
        fit.imd = block_importance(fit)
    if select_rule:
        if select_rule == "t":
            fit.selected = selection.by_t_test(per_tree_importance(fit))
        elif select_rule == "mixture":
            fit.selected = selection.by_mixture(selection.mixture_posteriors(fit.imd))
        elif select_rule == "adaptive":
            fit.selected = adaptive_selection(fit, **(adaptive_options or {}))
        else:
            fit.selected = selection.by_threshold(fit.imd)
        fit.selected = cut(fit.selected)
        if robust:
            again = run(spark, fit.get_data("selected"), k or fit.clusters["shared"]["k"], trees, fit.model_v, fused_v, how, main, seed=seed, scale=False, filter_mode="none", connections=[p for p in fit.pairs])
            fit.robust_clusters = again.clusters
    return fit


def simple(spark: SparkSession, long: DataFrame, k: int | None = None, trees: int = 500, **options) -> Fit:
    """run with the usual settings."""
    return run(spark, long, k, trees, **options)


def _sided(fit: Fit, trees: bool) -> DataFrame:
    out = None
    spark = fit.spark
    for p, m in zip(fit.pairs, fit.models, strict=True):
        for side, block, names in (("split_var", p[-1], m.x_names), ("msrv", p[0], m.y_names)):
            if side == "msrv" and len(set(p)) == 1:
                continue
            features = spark.createDataFrame(list(enumerate(names)), "var int, feature string")
            one = importance.per_tree(m.nodes, side)
            if trees:
                every = features.crossJoin(spark.range(m.control.trees).select(F.col("id").cast("int").alias("tree")))
                rows = every.join(one, ["tree", "var"], "left").fillna(0.0, ["imd"]).select(F.lit(block).alias("block"), "feature", F.concat(F.lit("_".join(p) + ":"), "tree").alias("tree"), "imd")
            else:
                rows = importance.forest_mean(one, m.control.trees, features).select(F.lit("_".join(p)).alias("model"), F.lit(block).alias("block"), "feature", "imd")
            out = rows if out is None else out.unionByName(rows)
    return out


def block_importance(fit: Fit, unit: bool = False) -> DataFrame:
    return cut(importance.block_mean(_sided(fit, False), unit))


def refit_errors(spark: SparkSession, x: np.ndarray, y: np.ndarray, x_names: list[str], y_names: list[str], control: forest.Control):
    """A score() for selection.adaptive: the out-of-bag error of a forest on each job's features, all grown in one job."""

    def score(kept: dict, jobs: list) -> list[float]:
        grown = forest.grow_trees(spark, [
            {"conn_id": c, "rep": 0, "x": x[:, [x_names.index(n) for n in kept[t]["X"]]], "y": y[:, [y_names.index(n) for n in kept[t]["Y"]]], "control": replace(control, seed=s)}
            for c, (t, s) in enumerate(jobs)
        ])
        _, m = forest.tables(grown, list(range(len(x))))
        values = spark.createDataFrame([(i, s, f"{s}:{n}", float(v)) for s, data, names in (("X", x, x_names), ("Y", y, y_names)) for i, row in enumerate(data) for n, v in zip(names, row, strict=True)], "sample_idx int, block string, feature string, value double")
        keep = spark.createDataFrame([(c, f"{s}:{n}") for c, (t, _) in enumerate(jobs) for s in "XY" for n in kept[t][s]], "c int, feature string")
        # a job's samples are samples of their own: both parts of the key are kept, in one number without overlap
        own = lambda c, i: F.col(c).cast("long") * len(x) + F.col(i)
        w = leaves.oob_weights(m.withColumn("tree", F.struct("conn_id", "tree")).withColumn("sample_idx", own("conn_id", "sample_idx")))
        v = values.join(F.broadcast(keep), "feature").withColumn("sample_idx", own("c", "sample_idx"))
        p = w.join(v.withColumnRenamed("sample_idx", "j"), "j").groupBy("i", "c", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("p"))
        e = p.join(v.withColumnRenamed("sample_idx", "i"), ["i", "c", "feature"]).groupBy("c", "feature").agg(F.avg(F.pow(F.col("p") - F.col("value"), 2)).alias("e"))
        found = dict(e.groupBy("c").agg(F.avg("e")).collect())
        return [found.get(c, math.nan) for c in range(len(jobs))]

    return score


def adaptive_selection(fit: Fit, taus=None, repeats: int = 3, tol: float = 0.01) -> DataFrame:
    """block, feature, imd, selected: a feature stays if a connection's own cut-off, at which its refits stop getting worse,
    keeps it. Connections are refitted one after the other, all cut-offs and seeds of one in a single job."""
    kept = set()
    for p, m in zip(fit.pairs, fit.models, strict=True):
        if m.y is None or len(set(p)) == 1:
            continue
        weights = {}
        for side, column, names in (("X", "split_var", m.x_names), ("Y", "msrv", m.y_names)):
            mean = dict(importance.per_tree(m.nodes, column).groupBy("var").agg((F.sum("imd") / m.control.trees).alias("w")).collect())
            weights[side] = {n: float(mean.get(k, 0.0)) for k, n in enumerate(names)}
        got = selection.adaptive(weights, refit_errors(fit.spark, m.x, m.y, m.x_names, m.y_names, m.control), taus, repeats, tol, m.control.seed)
        kept |= {(b, n) for b, s in ((p[-1], "X"), (p[0], "Y")) for n in got["kept"][s]}
    chosen = fit.spark.createDataFrame(sorted(kept), "block string, feature string").withColumn("selected", F.lit(True))
    return fit.imd.join(chosen, ["block", "feature"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def per_tree_importance(fit: Fit) -> DataFrame:
    return _sided(fit, True)


def stability(fit: Fit, similarity: DataFrame, base: np.ndarray, k: int, repetitions: int = 50, share: float = 0.8, method: str = "spectral", seed: int = 529, truth=None) -> dict:
    """Clusters of resamples against the base (and a truth): metrics by repetition, co-assignment and its own clusters.
    Repetitions are clustered in parallel; the similarity is broadcast, being of SAMPLES squared at most."""
    import pandas as pd

    spark, n = fit.spark, len(base)
    held = spark.sparkContext.broadcast(dense(similarity, n))
    draws = metrics.resamples(spark.range(n).select(F.col("id").alias("sample_idx")), repetitions, share, seed)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        idx = pdf["sample_idx"].to_numpy()
        labels = cluster_similarity(held.value[np.ix_(idx, idx)], k, method)["labels"]
        return pd.DataFrame({"rep": pdf["rep"], "sample_idx": idx, "cluster": labels})

    labels = cut(draws.groupBy("rep").applyInPandas(one, "rep int, sample_idx long, cluster int"))
    out = {"labels": labels, "co_assignment": cut(metrics.co_assignment(labels))}
    for name, ref in (("base", base), ("truth", truth)):
        if ref is not None:
            pairs = labels.join(reports.labels_frame(spark, range(n), ref).withColumnRenamed("cluster", "ref"), "sample_idx").withColumnRenamed("cluster", "pred")
            out[name] = metrics.agreement(pairs, ["rep"])
    co = dense(out["co_assignment"].withColumnRenamed("share", "w"), n)
    out["consensus"] = cluster_similarity(co, k, method)["labels"]
    return out


def embed(similarity: DataFrame, n: int, **options) -> dict:
    return tsne(dense(similarity, n), **options)
