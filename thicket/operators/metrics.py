"""Agreement of labelings, co-assignment and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(pairs: DataFrame, by=()) -> DataFrame:
    """pred, ref, n, n_pred, n_ref, total; pairs with a null are out."""
    n = pairs.where("pred IS NOT NULL AND ref IS NOT NULL").groupBy(*by, "pred", "ref").agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    return n.withColumns({"n_pred": over("pred"), "n_ref": over("ref"), "total": over()})


def agreement(pairs: DataFrame, by=()) -> DataFrame:
    """n, ari, jaccard, nmi, purity of (pred, ref) pairs, from the contingency table alone. Null where undefined."""
    c = contingency(pairs, by)
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    own = lambda x: F.sum(two(x) * F.col("n") / F.col(x))  # noqa: E731  each margin counted once
    p = F.col("n") / F.col("total")
    part = c.withColumn("best", F.row_number().over(Window.partitionBy(*by, "pred").orderBy(F.desc("n"))))
    a = part.groupBy(*by).agg(
        F.max("total").alias("n"), F.sum(two("n")).alias("both"), own("n_pred").alias("x"), own("n_ref").alias("y"),
        F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("n_pred") * F.col("n_ref")))).alias("mi"),
        (-F.sum(p * F.ln(F.col("n_pred") / F.col("total")))).alias("hx"), (-F.sum(p * F.ln(F.col("n_ref") / F.col("total")))).alias("hy"),
        F.sum(F.when(F.col("best") == 1, F.col("n"))).alias("hits"),
    )
    e = F.col("x") * F.col("y") / two("n")
    mean = (F.col("x") + F.col("y")) / 2
    union = F.col("x") + F.col("y") - F.col("both")
    h = F.sqrt(F.col("hx") * F.col("hy"))
    return a.select(
        *by, "n", F.when(F.abs(mean - e) > 1e-12, (F.col("both") - e) / (mean - e)).alias("ari"), F.when(union > 0, F.col("both") / union).alias("jaccard"),
        F.when(h > 1e-12, F.col("mi") / h).alias("nmi"), (F.col("hits") / F.col("n")).alias("purity"),
    )


def metric_matrix(labels: DataFrame, metric: str = "ari") -> DataFrame:
    """name_a, name_b, value for each pair of labelings of (name, sample_idx, cluster) over their common samples."""
    a, b = labels.alias("a"), labels.alias("b")
    pairs = a.join(b, F.col("a.sample_idx") == F.col("b.sample_idx")).where("a.name <> b.name").select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.col("a.cluster").alias("pred"), F.col("b.cluster").alias("ref"))
    off = agreement(pairs, ["name_a", "name_b"]).select("name_a", "name_b", F.col(metric).alias("value"))
    return off.unionByName(labels.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(1.0).alias("value")).distinct())


def co_assignment(labels: DataFrame) -> DataFrame:
    """i, j, share: how often i and j share a cluster among the repetitions that hold both. labels: (rep, sample_idx, cluster)."""
    a, b = labels.select("rep", F.col("sample_idx").alias("i"), F.col("cluster").alias("x")), labels.select("rep", F.col("sample_idx").alias("j"), F.col("cluster").alias("y"))
    return a.join(b, "rep").groupBy("i", "j").agg(F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("share"))


def resamples(samples: DataFrame, repetitions: int, share: float = 0.8, seed: int = 529, bootstrap: bool = False) -> DataFrame:
    """(rep, sample_idx): for each repetition that share of the samples, by seeded hash; bootstrap: distinct draws with
    replacement."""
    reps = samples.sparkSession.range(repetitions).select(F.col("id").cast("int").alias("rep"))
    n = samples.count()
    if bootstrap:
        place = samples.select("sample_idx", (F.row_number().over(Window.orderBy("sample_idx")) - 1).alias("at"))
        draws = reps.crossJoin(samples.sparkSession.range(n)).select("rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "id"), F.lit(n)).alias("at")).distinct()
        return draws.join(place, "at").select("rep", "sample_idx")
    order = Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), "rep", "sample_idx"), "sample_idx")
    return reps.crossJoin(samples.select("sample_idx")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(2, round(share * n))).select("rep", "sample_idx")


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """sample_idx, cluster, s from (i, j, d) off the diagonal and (sample_idx, cluster)."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    d = distances.join(labels.select(F.col("sample_idx").alias("i"), F.col("cluster").alias("ci")), "i").join(labels.select(F.col("sample_idx").alias("j"), F.col("cluster").alias("cj")), "j")
    sums = d.groupBy("i", "ci", "cj").agg(F.sum("d").alias("t")).join(size.withColumnRenamed("cluster", "cj"), "cj")
    own = F.col("ci") == F.col("cj")
    ab = sums.groupBy("i", "ci").agg(F.max(F.when(own, F.col("t") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("t") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    return ab.select(F.col("i").alias("sample_idx"), F.col("ci").alias("cluster"), F.when(F.coalesce("n", F.lit(1)) > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0).alias("s"))


def mean_silhouette(s: DataFrame) -> DataFrame:
    return s.agg(F.avg("s").alias("silhouette"))
