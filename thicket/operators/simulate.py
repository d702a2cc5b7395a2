"""Blocks with known structure: labels that all blocks share, labels of each block's own, and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate_blocks(spark: SparkSession, n: int = 500, features: dict[str, int] | None = None, shared_share=(0.3, 0.3, 0.4), shared_shift: float = 2.0, own_shift: float = 1.0, share_of_features: float = 0.2, own_classes: int = 2, seed: int = 529) -> tuple[DataFrame, DataFrame]:
    """Long blocks and (sample_idx, shared, block, own): value = noise + shift of the shared label in one part of the
    features + shift of the block's own label in another. Noise and labels are functions of seeded hashes, so partitions
    don't matter."""
    features = features or {"methyl": 60, "gene": 40, "protein": 30}
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    samples = spark.range(n).select(F.col("id").alias("sample_idx"))
    u, bound, label = unit(F.lit("shared"), F.col("sample_idx")), 0.0, None
    for k, share in enumerate(shared_share):
        bound += share
        label = F.when(u < bound, k) if label is None else label.when(u < bound, k)
    samples = samples.withColumn("shared", label.otherwise(len(shared_share) - 1))
    columns = spark.createDataFrame([(b, i) for b, p in features.items() for i in range(p)], "block string, feature_idx int")
    blocks = spark.createDataFrame([(b,) for b in features], "block string")
    truth = samples.crossJoin(blocks).withColumn("own", F.floor(unit(F.lit("own"), F.col("block"), F.col("sample_idx")) * own_classes).cast("int"))
    normal = F.sqrt(-2 * F.ln(unit(F.lit("r"), "block", "feature_idx", "sample_idx"))) * F.cos(6.283185307179586 * unit(F.lit("a"), "block", "feature_idx", "sample_idx"))
    part = lambda what: unit(F.lit(what), "block", "feature_idx") < share_of_features
    target = F.pmod(F.xxhash64(F.lit("of"), "block", "feature_idx"), F.lit(len(shared_share)))
    value = normal + F.when(part("s") & (F.col("shared") == target), shared_shift).otherwise(0.0) + F.when(part("o"), own_shift * F.col("own")).otherwise(0.0)
    long = truth.join(columns, "block").select("block", "sample_idx", F.concat("block", F.lit("_"), "feature_idx").alias("feature"), "feature_idx", value.alias("value"))
    return long, truth
