"""Fusing the models' weights by response, and splitting blocks into what is shared and what is their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.operators import matrix as M


def shares(scores: DataFrame, by=("response",), floor: float = 0.0, power: float = 1.0, uniform: bool = False, fallback: bool = True) -> DataFrame:
    """model, response, alpha from (model, response, score): max(score, floor)^power over its sum within the response;
    without any mass the same for all, or null if there's no fallback."""
    mass = F.lit(1.0) if uniform else F.pow(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(float(floor))), F.lit(float(power)))
    over = Window.partitionBy(*by)
    s = scores.withColumn("m", F.greatest(mass, F.lit(0.0))).withColumn("t", F.sum("m").over(over)).withColumn("n", F.count("*").over(over))
    return s.withColumn("alpha", F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(1 / F.col("n") if fallback else None)).select("model", *by, "alpha")


def by_response(weights: DataFrame, alphas: DataFrame) -> DataFrame:
    """(response, i, j, w): the models' weights by alpha, rows normalised. weights: (model, i, j, w)."""
    mixed = weights.join(F.broadcast(alphas), "model").groupBy("response", "i", "j").agg(F.sum(F.col("alpha") * F.col("w")).alias("w"))
    return M.normalise_rows(mixed, ["response"])


def overall(fused: DataFrame, how: str = "average", v: int | None = None, normalise: bool = True, ties: bool = True, responses: list[str] | None = None, k: int | None = None) -> DataFrame:
    """(i, j, w): mean over the responses, or their least (then normalised), cut to the v largest if asked. k: their number,
    which is otherwise counted, by a pass of its own."""
    k = k or fused.select("response").distinct().count()
    if responses and (missing := set(responses) - {r[0] for r in fused.select("response").distinct().collect()}):
        raise ValueError(f"blocks {sorted(missing)} are nobody's response")
    if how == "average":
        out = fused.groupBy("i", "j").agg((F.sum("w") / k).alias("w"))
    else:
        out = M.normalise_rows(fused.groupBy("i", "j").agg(F.min("w").alias("w"), F.count("*").alias("n")).where(F.col("n") == k).drop("n"))
    out = M.top_entries(out, v, ties=ties)
    return M.normalise_rows(out) if v is not None and normalise else out


def reconstruct(weights: DataFrame, scores: DataFrame, model_v: int | None = 10, fused_v: int | None = None, how: str = "average", **options) -> tuple[DataFrame, DataFrame]:
    """Fused weights by response and overall, from raw (model, i, j, w) and (model, response, score)."""
    ready = M.prepare(weights, model_v, ["model"])
    fused = by_response(ready, shares(scores, **options))
    return fused, overall(fused, how, fused_v, k=scores.select("response").distinct().count())


def residual(long: DataFrame, fused: DataFrame) -> DataFrame:
    """Long blocks less what each block's own fused weights rebuild of it. fused: (response, i, j, w)."""
    x = long.select(F.col("block").alias("response"), F.col("sample_idx").alias("j"), "feature", F.col("value").alias("x"))
    shared = fused.join(x, ["response", "j"]).groupBy(F.col("response").alias("block"), F.col("i").alias("sample_idx"), "feature").agg(F.sum(F.col("w") * F.col("x")).alias("shared"))
    return long.join(shared, ["block", "sample_idx", "feature"], "left").withColumn("value", F.col("value") - F.coalesce("shared", F.lit(0.0))).drop("shared")


def shared_fraction(long: DataFrame, rest: DataFrame, eps: float = 1e-12) -> DataFrame:
    """block, shared_frac: 1 less the share of its squares that is left; null for a block of zeros. May be negative."""
    x = long.groupBy("block").agg(F.sum(F.col("value") * F.col("value")).alias("x"))
    r = rest.groupBy("block").agg(F.sum(F.col("value") * F.col("value")).alias("r"))
    return x.join(r, "block").select("block", F.when(F.sqrt("x") > eps, 1 - F.col("r") / F.col("x")).alias("shared_frac"))


def rank_connections(models: DataFrame, drop: float = 0.2, one_per_pair: bool = True) -> DataFrame:
    """model, response, predictor, rank_sum, kept, selected from (.., quality, nmse or null): average ranks of quality (high
    is good) and error (low is good); the worst share `drop` goes; of the two directions of a pair the better stays."""
    every = Window.partitionBy()

    def average_rank(column: str, order):
        return F.rank().over(Window.orderBy(order(column))) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2

    r = models.withColumn("rank_sum", average_rank("quality", F.desc) + F.when(F.col("nmse").isNull(), 0.0).otherwise(average_rank("nmse", F.asc)))
    r = r.withColumn("limit", F.expr(f"percentile(rank_sum, {1 - drop})").over(every))
    r = r.withColumn("kept", (F.col("rank_sum") <= F.col("limit")) | (F.col("rank_sum") == F.min("rank_sum").over(every)))
    pair = Window.partitionBy(F.least("response", "predictor"), F.greatest("response", "predictor"), "kept").orderBy("rank_sum", F.desc("quality"), "model")
    best = F.row_number().over(pair) == 1 if one_per_pair else F.lit(True)
    return r.withColumn("selected", F.col("kept") & best).select("model", "response", "predictor", "rank_sum", "kept", "selected")
