"""Tables behind reports: composition of clusters, survival curves, top features, networks, tidy labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def composition(pairs: DataFrame, clusters: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """cluster, annotation, n, of_cluster, of_annotation, of_total for every cell, also the empty ones."""
    p = pairs.where("cluster IS NOT NULL AND annotation IS NOT NULL")
    rows = clusters or p.select("cluster").distinct()
    columns = annotations or p.select("annotation").distinct()
    n = rows.crossJoin(columns).join(p.groupBy("cluster", "annotation").agg(F.count("*").alias("n")), ["cluster", "annotation"], "left").fillna(0, ["n"])
    share = lambda *c: F.when(F.sum("n").over(Window.partitionBy(*c)) > 0, F.col("n") / F.sum("n").over(Window.partitionBy(*c))).otherwise(0.0)
    return n.select("cluster", "annotation", "n", share("cluster").alias("of_cluster"), share("annotation").alias("of_annotation"), share().alias("of_total"))


def survival(rows: DataFrame) -> DataFrame:
    """group, time, at_risk, events, survival of (group, time, event 0/1): product limit."""
    t = rows.where("time IS NOT NULL AND event IS NOT NULL AND group IS NOT NULL").groupBy("group", "time").agg(F.sum("event").alias("events"), F.count("*").alias("leaving"))
    later = Window.partitionBy("group").orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy("group").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    r = t.withColumn("at_risk", F.sum("leaving").over(later))
    alive = F.when(F.max((F.col("events") == F.col("at_risk")).cast("int")).over(upto) == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(upto)))
    return r.select("group", "time", "at_risk", "events", alive.alias("survival"))


def log_rank(rows: DataFrame) -> DataFrame:
    """observed, expected, variance, chi2 of the first of two groups."""
    r = rows.where("time IS NOT NULL AND event IS NOT NULL AND group IS NOT NULL")
    first = r.agg(F.min("group").alias("g"))
    t = r.crossJoin(F.broadcast(first)).groupBy("time").agg(
        F.sum("event").alias("d"), F.count("*").alias("n"), F.sum(F.when(F.col("group") == F.col("g"), F.col("event")).otherwise(0)).alias("d1"), F.count(F.when(F.col("group") == F.col("g"), 1)).alias("n1")
    )
    later = Window.orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumns({"r": F.sum("n").over(later), "r1": F.sum("n1").over(later)}).where("d > 0")
    share = F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    return t.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(v).alias("variance")).withColumn("chi2", F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))


def split_groups(rows: DataFrame, column: str, how: str = "median") -> DataFrame:
    """rows with group 'high' or 'low' by the column's median or mean, or by the cut with the largest log-rank statistic
    (maxstat: among the ten per cent steps)."""
    if how in ("median", "mean"):
        at = rows.agg(F.median(column) if how == "median" else F.avg(column)).first()[0]
    else:
        cuts = sorted(set(rows.agg(F.percentile(column, [k / 10 for k in range(1, 10)])).first()[0]))
        tried = {c: log_rank(rows.withColumn("group", F.when(F.col(column) > c, "high").otherwise("low"))).first()["chi2"] or 0.0 for c in cuts}
        at = max(tried, key=tried.get)
    return rows.withColumn("group", F.when(F.col(column) > at, "high").otherwise("low"))


def top_features(imd: DataFrame, n: int = 20) -> DataFrame:
    """The n largest importances above 0 of each block, ties by name."""
    order = Window.partitionBy("block").orderBy(F.desc(F.round("imd", 12)), "feature")
    return imd.where("imd > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tidy_importance(imd: DataFrame, source: str = "imd", n: int | None = None) -> DataFrame:
    """source, block, variable, weight, abs_weight, rank."""
    order = Window.partitionBy("block").orderBy(F.desc(F.round("abs_weight", 12)), "variable")
    out = imd.select(F.lit(source).alias("source"), "block", F.col("feature").alias("variable"), F.col("imd").alias("weight"), F.abs("imd").alias("abs_weight")).withColumn("rank", F.row_number().over(order))
    return out if n is None else out.where(F.col("rank") <= n)


def tidy_clusters(parts: dict[str, DataFrame]) -> DataFrame:
    """branch, sample_idx, cluster of the shared and the blocks' own labels, each once."""
    out = None
    for branch, labels in parts.items():
        own = labels.select(F.lit(branch).alias("branch"), "sample_idx", "cluster")
        out = own if out is None else out.unionByName(own)
    return out


def network(w: DataFrame, at: float | None = None, q: float = 0.75) -> DataFrame:
    """i < j and w above the cut-off (by default the q-quantile of positive weights): nodes without an edge vanish."""
    pairs = w.where("i < j AND w > 0")
    if at is not None:
        return pairs.where(F.col("w") > at)
    limit = pairs.agg(F.expr(f"percentile(w, {q})").alias("_c"))  # one row
    return pairs.crossJoin(F.broadcast(limit)).where("round(w, 12) > round(_c, 12)").drop("_c")


def chords(w: DataFrame, groups: DataFrame, over: float = 0.0) -> DataFrame:
    """i, j, w, group_i, group_j of the pairs above `over`, each once; groups: (i, group)."""
    other = groups.select(F.col("i").alias("j"), F.col("group").alias("group_j"))
    return w.where((F.col("i") < F.col("j")) & (F.col("w") > over)).join(groups.withColumnRenamed("group", "group_i"), "i").join(other, "j").select("i", "j", "w", "group_i", "group_j")


def tuning_series(found: dict) -> list[tuple[str, float, float, bool]]:
    """(series, x, y, chosen) rows of a choice of k: what a plot of it shows. found: of spectral() or pam_tuned()."""
    rows = []
    if "gaps" in found:
        rows += [("eigenvalue difference", float(k), float(g), k == found["k"]) for k, g in zip(found["ks"], found["gaps"], strict=True)]
        rows += [("eigenvalue", float(i + 1), float(v), False) for i, v in enumerate(found["values"])]
    else:
        rows += [("score", float(k), float(s), k == found["k"]) for k, s in zip(found["tried"], found["scores"], strict=True)]
        rows += [("step", float(k), float(s), k == found["k"]) for k, s in zip(found["tried"], found["steps"], strict=False)]
    return rows


def labels_frame(spark, samples: list, labels) -> DataFrame:
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(samples, labels, strict=True)], "sample_idx long, cluster int")
