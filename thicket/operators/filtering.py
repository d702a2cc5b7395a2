"""Feature pre-selection, scaling and subsets of long blocks."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.sources.blocks import kind_of

# Features kept of each kind, by sample count where it matters, and other names of the kinds.
DEFAULT_TOP = {"rna": 5000, "protein": math.inf, "unknown": math.inf}
MIRNA_TOP = ((149, 500), (math.inf, 1000))
METHYLATION_TOP = ((100, 5000), (250, 10000), (500, 15000), (math.inf, 20000))
ALIASES = {
    "mrna": "rna",
    "expression": "rna",
    "transcript": "rna",
    "gene": "rna",
    "micro_rna": "mirna",
    "mi_rna": "mirna",
    "methyl": "methylation",
    "methy": "methylation",
    "dnam": "methylation",
    "prot": "protein",
    "rppa": "protein",
}


def default_top(kind: str, samples: int) -> float:
    steps = {"mirna": MIRNA_TOP, "methylation": METHYLATION_TOP}.get(kind)
    if steps is None:
        return DEFAULT_TOP[kind]
    return next(n for limit, n in steps if samples <= limit)


def tops_by_kind(wanted: dict | None) -> dict[str, float]:
    """Wanted tops by kind; other names of a kind count as it, a name of no kind is left out with a warning."""
    named = {ALIASES.get(str(k).lower(), str(k).lower()): v for k, v in (wanted or {}).items()}
    kinds = {*DEFAULT_TOP, "mirna", "methylation"}
    if odd := sorted(set(named) - kinds):
        warnings.warn(f"no kind of block is named {', '.join(odd)}", stacklevel=2)
    return {k: float(v) for k, v in named.items() if k in kinds}


def top_of(block: str, place: int, samples: int, mode: str = "auto", by_kind: dict | None = None, manual=None) -> float:
    """How many features a block keeps: inf is all. manual: by name, by place (from 1) as text, or a list by place."""
    if mode == "none":
        return math.inf
    if mode == "manual":
        n = manual.get(block, manual.get(str(place + 1))) if isinstance(manual, dict) else manual[place] if manual and place < len(manual) else None
    else:
        kind = kind_of(block)
        n = tops_by_kind(by_kind).get(kind)
        if n is None or kind in ("mirna", "methylation") and not math.isfinite(n):
            n = default_top(kind, samples)
    return math.inf if n is None or not math.isfinite(n) or n <= 0 else max(1, math.floor(n))


def feature_stats(long: DataFrame) -> DataFrame:
    """block, feature, feature_idx, n, low, high, mean, variance, mad (median absolute deviation, unscaled)."""
    keys = ["block", "feature", "feature_idx"]
    base = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.median("value").alias("middle")
    )
    mad = long.join(base.select(*keys, "middle"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("value") - F.col("middle"))).alias("mad"))
    return base.join(mad, keys).drop("middle")


def keep_top(stats: DataFrame, tops: dict[str, float], score: str = "mad") -> DataFrame:
    """Features that vary, the best of each block first (ties by place), no more than its top."""
    order = Window.partitionBy("block").orderBy(F.desc("score"), "feature_idx")
    most = None
    for block, n in tops.items():
        if math.isfinite(n):
            own = F.when(F.col("block") == block, F.lit(int(n)))
            most = own if most is None else F.coalesce(most, own)
    ranked = stats.where("low < high").withColumn("score", F.coalesce(F.col(score), F.lit(-math.inf))).withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= F.coalesce(most, F.lit(2**31 - 1)))


def filter_blocks(long: DataFrame, tops: dict[str, float], score: str = "mad") -> tuple[DataFrame, DataFrame]:
    """The kept features' rows, and a summary of each block."""
    stats = feature_stats(long)
    kept = keep_top(stats, tops, score)
    n = lambda c: F.count(F.when(c, 1))
    summary = stats.groupBy("block").agg(F.max("n").alias("samples"), F.count("*").alias("features"), n(F.col("low") < F.col("high")).alias("varying"))
    summary = summary.join(kept.groupBy("block").agg(F.count("*").alias("kept")), "block", "left").fillna(0, ["kept"])
    return long.join(kept.select("block", "feature"), ["block", "feature"], "left_semi"), summary


def zscore(long: DataFrame) -> DataFrame:
    """value less its feature's mean, in sample standard deviations; one shuffle by feature."""
    by = Window.partitionBy("block", "feature")
    return long.withColumn("value", (F.col("value") - F.avg("value").over(by)) / F.stddev_samp("value").over(by))


def draw_samples(samples: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the rows, by a seeded hash of sample_idx, so the same ones each time."""
    return samples.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_idx").cast("string"))), "sample_idx").limit(n)


def tuning_size(n: int) -> int:
    return n if n <= 600 else 600 if n <= 2000 else 800


def subset_matrix(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows and columns of a (.., i, j, w) matrix that are among samples."""
    i, j = (samples.select(F.col("sample_idx").alias(c)) for c in "ij")
    return matrix.join(i, "i", "left_semi").join(j, "j", "left_semi")


def normalised_weights(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Every feature's weight, not negative, of total 1."""
    joined = features.join(weights, "feature", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if joined.where("weight < 0 OR isnan(weight)").limit(1).count() or not (joined.agg(F.sum("weight")).first()[0] or 0) > 0:
        raise ValueError("weights must be finite, not negative, and positive somewhere")
    return joined.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
