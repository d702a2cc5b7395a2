"""Square sample matrices as (i, j, w) rows, absent entries 0. `by` names further key columns, as model or response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights are rounded so before they are ranked: sums in another order must not split ties.
DIGITS = 12


def adjust(w: DataFrame, by=(), eps: float = 1e-8) -> DataFrame:
    """Rows divided by 1 less their diagonal (eps at least), diagonal out."""
    row = Window.partitionBy(*by, "i")
    own = F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.col("w"))).over(row), F.lit(0.0))
    return w.withColumn("w", F.col("w") / F.greatest(1 - own, F.lit(eps))).where("i <> j")


def top_entries(w: DataFrame, v: int | None, by=(), ties: bool = True) -> DataFrame:
    """Entries of each row not below its v-th largest; without ties exactly v, the smaller j first."""
    if v is None:
        return w
    order = Window.partitionBy(*by, "i").orderBy(F.desc(F.round("w", DIGITS)), *([] if ties else ["j"]))
    return w.withColumn("rk", (F.rank() if ties else F.row_number()).over(order)).where(F.col("rk") <= v).drop("rk")


def normalise_rows(w: DataFrame, by=(), eps: float = 1e-12) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy(*by, "i"))
    return w.withColumn("_t", total).where(F.abs("_t") > eps).withColumn("w", F.col("w") / F.col("_t")).drop("_t")


def prepare(w: DataFrame, v: int | None = None, by=(), ties: bool = True) -> DataFrame:
    """adjust, top_entries, normalise_rows; all three windows share one shuffle by row."""
    return normalise_rows(top_entries(adjust(w, by), v, by, ties), by)


def row_entropy(w: DataFrame, by=()) -> DataFrame:
    """i, entropy (of its normalised positive entries), entries, n_eff (exp of it, 1 for a single entry)."""
    p = normalise_rows(w.where("w > 0"), by)
    return p.groupBy(*by, "i").agg((-F.sum(F.col("w") * F.ln("w"))).alias("entropy"), F.count("*").alias("entries")).withColumn("n_eff", F.when(F.col("entries") <= 1, 1.0).otherwise(F.exp("entropy")))


def effective_top(w: DataFrame, n: int, q: float = 0.5, least: int = 10) -> int:
    """A cut-off from the q-quantile of the rows' effective numbers of neighbours."""
    found = row_entropy(w).agg(F.percentile("n_eff", q)).first()[0]
    return int(min(n, max(least, -(-(found or 0) // 1))))


def mean_entropy(w: DataFrame, n: int, by=()) -> DataFrame:
    """Mean row entropy as a share of ln n, within [0, 1]; rows without entries count 0."""
    total = row_entropy(w, by).groupBy(*by).agg(F.sum("entropy").alias("_s")) if by else row_entropy(w).agg(F.sum("entropy").alias("_s"))
    share = F.col("_s") / (n * F.ln(F.lit(float(n))))
    return total.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))).alias("entropy"))


def concentration(w: DataFrame) -> DataFrame:
    """1 less the mean of each row's entropy over the log of its entries."""
    r = row_entropy(w)
    return r.agg((1 - F.avg(F.when(F.col("entries") > 1, F.col("entropy") / F.ln("entries")).otherwise(0.0))).alias("concentration"))


def transpose(w: DataFrame) -> DataFrame:
    return w.withColumnRenamed("i", "_x").withColumnRenamed("j", "i").withColumnRenamed("_x", "j")


def larger_direction(w: DataFrame, by=()) -> DataFrame:
    return w.unionByName(transpose(w)).groupBy(*by, "i", "j").agg(F.max("w").alias("w"))


def second_order(w: DataFrame, by=()) -> DataFrame:
    """W W^T without its diagonal: rows that share columns. The join key is the column, so cut rows to their top first.
    Only i < j is multiplied; the mirror is a projection."""
    a, b = w.select(*by, "i", "j", "w"), w.select(*by, F.col("i").alias("k"), "j", F.col("w").alias("u"))
    upper = a.join(b, [*by, "j"]).where("i < k").groupBy(*by, "i", F.col("k").alias("j")).agg(F.sum(F.col("w") * F.col("u")).alias("w"))
    return upper.unionByName(transpose(upper))


def first_order(w: DataFrame, by=()) -> DataFrame:
    return w.unionByName(transpose(w)).where("i <> j").groupBy(*by, "i", "j").agg((F.sum("w") / 2).alias("w"))


def nearest(s: DataFrame, q: int, by=(), symmetric: bool = True) -> DataFrame:
    kept = top_entries(s, q, by, ties=False)
    return larger_direction(kept, by) if symmetric else kept


def laplacian(s: DataFrame, by=()) -> DataFrame:
    """Degrees on the diagonal, less the similarities."""
    return s.select(*by, "i", "j", (-F.col("w")).alias("w")).unionByName(s.groupBy(*by, "i").agg(F.sum("w").alias("w")).select(*by, "i", F.col("i").alias("j"), "w"))


def times_block(w: DataFrame, long: DataFrame, by=()) -> DataFrame:
    """W X: weighted sums of the neighbours' values."""
    x = long.select("block", F.col("sample_idx").alias("j"), "feature", F.col("value").alias("x"))
    return w.join(x, [*by, "j"] if "block" in by else "j").groupBy("block", *[c for c in by if c != "block"], F.col("i").alias("sample_idx"), "feature").agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def modularity(w: DataFrame, labels: DataFrame) -> DataFrame:
    """Of labels (i, cluster) on a symmetric hollow matrix."""
    a = w.join(labels.select("i", F.col("cluster").alias("ci")), "i").join(labels.select(F.col("i").alias("j"), F.col("cluster").alias("cj")), "j")
    parts = a.groupBy("ci").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("inside"))
    return parts.agg(F.sum("d").alias("t"), F.sum("inside").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")).select((F.col("s") / F.col("t") - F.col("q") / (F.col("t") * F.col("t"))).alias("modularity"))


def giant_share(w: DataFrame, n: int, over: float = 0.0, symmetric: bool = True) -> float:
    """Share of the n samples in the largest component of the entries above `over`; 1 for one sample or none.

    A component takes an entry in either direction for an edge; without `symmetric` the weaker direction must be one too."""
    if n <= 1:
        return 1.0
    edges = w.where((F.col("w") > over) & (F.col("i") != F.col("j")))
    if not symmetric:
        edges = edges.join(transpose(edges.select("i", "j")), ["i", "j"], "left_semi")
    largest = components(edges.select("i", "j", "w"), over).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (largest or 1) / n


def components(w: DataFrame, over: float = 0.0) -> DataFrame:
    """i, component (least sample reachable by entries above `over` in either direction); labels are halved in path
    length each round and every round is checkpointed."""
    from thicket.plans.session import cut

    edges = cut(w.where((F.col("w") > over) & (F.col("i") != F.col("j"))).select("i", "j").unionByName(transpose(w.where((F.col("w") > over) & (F.col("i") != F.col("j"))).select("i", "j"))).distinct())
    labels = cut(w.select("i").unionByName(w.select(F.col("j").alias("i"))).distinct().withColumn("c", F.col("i")))
    while True:
        told = edges.join(labels.withColumnRenamed("i", "j"), "j").select("i", "c", F.lit(None).cast("long").alias("o"))
        least = labels.select("i", "c", F.col("c").cast("long").alias("o")).unionByName(told).groupBy("i").agg(F.min("c").alias("c"), F.min("o").alias("o"))
        jump = labels.select(F.col("i").alias("c"), F.col("c").alias("further"))
        new = cut(least.join(jump, "c", "left").select("i", F.least("c", "further").alias("c"), "o"))
        labels = new.select("i", "c")
        if new.where("c < o").isEmpty():
            return labels.withColumnRenamed("c", "component")
