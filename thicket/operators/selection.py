"""Choosing features by their importance: fixed and adaptive cut-offs, t statistic, mixture, unions, counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.functions.mixture import fit_mixture
from thicket.functions.stats import t_sf
from thicket.sources import checks


def by_threshold(imd: DataFrame, tau: float = 1.0) -> DataFrame:
    """block, feature, imd, selected: above tau sample sds of the block's importances, strictly."""
    return imd.withColumn("selected", F.col("imd") > tau * F.stddev_samp("imd").over(Window.partitionBy("block")))


def levels(level, blocks: list[str]) -> Column:
    """Each row's level by its block; see checks.level."""
    if not isinstance(level, dict):
        return F.lit(checks.level(level, "all"))
    return F.element_at(F.create_map(*[F.lit(x) for b in blocks for x in (b, checks.level(level, b))]), F.col("block"))


def blocks_of(rows: DataFrame, level) -> list[str]:
    return sorted(r[0] for r in rows.select("block").distinct().collect()) if isinstance(level, dict) else []


def t_statistics(trees: DataFrame) -> DataFrame:
    """block, feature, t, df from (block, feature, tree, imd), zeros included: is a feature's mean over trees above the
    block's mean?"""
    f = trees.groupBy("block", "feature").agg(F.avg("imd").alias("m"), F.stddev_samp("imd").alias("s"), F.count("*").alias("n"), F.sum("imd").alias("total"))
    block = Window.partitionBy("block")
    overall = F.sum("total").over(block) / F.sum("n").over(block)
    return f.select("block", "feature", F.when(F.col("s") > 0, (F.col("m") - overall) / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"), F.col("m").alias("mean"), overall.alias("overall"))


def by_t_test(trees: DataFrame, level=0.05) -> DataFrame:
    """t_statistics with p (one-sided) and selected; a feature that is the same in all trees is kept if above the mean. level: of
    all blocks, by block, or auto."""
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([math.nan if v != v else t_sf(v, n) for v, n in zip(t, df, strict=True)])

    out = t_statistics(trees).withColumn("p", tail("t", F.col("df").cast("double")))
    return out.withColumn("selected", F.when(F.col("t").isNull(), F.col("mean") > F.col("overall")).otherwise(F.col("p") < levels(level, blocks_of(trees, level))))


def majority(votes: DataFrame, features: DataFrame) -> DataFrame:
    """block, feature, selected from (model, block, feature, keep): strictly more than half of its models keep it; a block
    without a model keeps all."""
    share = votes.groupBy("block", "feature").agg((F.avg(F.col("keep").cast("double")) > 0.5).alias("selected"))
    return features.join(share, ["block", "feature"], "left").withColumn("selected", F.coalesce("selected", F.lit(True)))


def mixture_posteriors(imd: DataFrame, noise: str = "normal", signal: str = "normal") -> DataFrame:
    """block, feature, imd, noise, signal, zero: a mixture for each block; one task holds one block's features."""
    def run(pdf):
        post = fit_mixture(pdf["imd"].to_numpy(), noise=noise, signal=signal).posterior
        return pdf.assign(noise=post[:, 0], signal=post[:, 1], zero=post[:, 2])

    return imd.select("block", "feature", "imd").groupBy("block").applyInPandas(run, "block string, feature string, imd double, noise double, signal double, zero double")


def by_mixture(posteriors: DataFrame, level=0.05) -> DataFrame:
    """selected: importance above 0 and chance of noise below level; level None: the longest run of features, by rising
    chance of noise, whose mean chance is 0.05 at most."""
    chance = F.col("noise") + F.col("zero")
    if level is not None:
        return posteriors.withColumn("selected", (F.col("imd") > 0) & (chance < levels(level, blocks_of(posteriors, level))))
    run = Window.partitionBy("block").orderBy(F.round("chance", 12), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return posteriors.withColumn("chance", chance).withColumn("fdr", F.avg("chance").over(run)).withColumn("selected", (F.col("imd") > 0) & (F.col("fdr") <= 0.05))


def union_of(*parts: DataFrame) -> DataFrame:
    """block, feature: selected in one part at least."""
    chosen = [p.where("selected").select("block", "feature") for p in parts]
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out.distinct()


def summary(selected: DataFrame, by=()) -> DataFrame:
    """block, p_total, p_selected, ratio."""
    n = F.count(F.when(F.col("selected"), 1))
    return selected.groupBy(*by, "block").agg(F.count("*").alias("p_total"), n.alias("p_selected"), (n / F.count("*")).alias("ratio"))


def tau_grid() -> list[float]:
    return [round(0.8 + 0.1 * k, 1) for k in range(24)]


def plateau(scores, tol: float = 0.01) -> int:
    """Place of the first candidate, from the second on, whose successor differs by tol at most; else of the least."""
    s = np.asarray(scores, float)
    for k in range(1, len(s) - 1):
        if np.isfinite(s[k : k + 2]).all() and abs(s[k + 1] - s[k]) <= tol:
            return k
    return int(np.nanargmin(s))


def adaptive(weights: dict[str, dict[str, float]], score, taus=None, repeats: int = 3, tol: float = 0.01, seed: int = 529) -> dict:
    """The cut-off tau * sd at which refits stop getting worse. score(kept, [(tau, seed)...]) returns the out-of-bag error
    of every (tau, seed) in one call, so that an implementation may grow all forests in one Spark job."""
    taus = tau_grid() if taus is None else list(taus)
    sds = {b: float(np.std(list(w.values()), ddof=1)) for b, w in weights.items()}
    kept = {t: {b: [f for f, v in w.items() if v > t * sds[b]] for b, w in weights.items()} for t in taus}
    usable = [t for t in taus if all(kept[t].values())]
    if not usable:
        raise ValueError("no cut-off leaves a feature in every block")
    jobs = [(t, seed + r) for t in usable for r in range(repeats)]
    errors = dict(zip(jobs, score(kept, jobs), strict=True))
    means = [float(np.mean([errors[t, seed + r] for r in range(repeats)])) for t in usable]
    tau = usable[plateau(means, tol)]
    return {"tau": tau, "kept": kept[tau], "thresholds": {b: tau * s for b, s in sds.items()}, "trace": list(zip(usable, means, strict=True))}
