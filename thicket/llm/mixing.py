"""Mixing sources to target weights by weighted fair queueing.

Within each source the documents are shuffled (by MD5 of seed and doc_id, so reruns agree) and every document gets a
virtual finish time: the words of its source up to and with it, divided by the source's target. A second pass over a
source goes on counting where the first ended. The document at which a source reaches its target is split there. Then all
documents of all passes are put in the global order of finish times, with a running total of words, and the order is
truncated where the total reaches the budget, the sum of the targets in whole words.

The global order is a range sort: up to the end of the budget every source is served at the rate of its target, so ranges
of equal virtual time hold equal numbers of words, and a range is the finish time's place among `ranges` equal ones, which
grow in number with the rows. A range's total is added to the ranges after it in a table of one row for each range; within
a range the total runs in a window. The words of a source before a document come the same way, from prefix sums over
buckets of the shuffle. So a source that holds a third of all rows is dealt out like any other, and no task sums all rows.

Targets share the budget by weight; none is above `repeats` times its source's size, and what is over goes to the others
by weight until none is above (water filling, in closed form).

Null text has size 0 and is never taken; a null source is a source of its own, last in order; a null doc_id sorts by its
size. Repeated rows each count. An empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import cut, read, unused

WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, "7"
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 1024, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of each source of (source, size) rows."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    cap = F.lit(repeats) * F.col("source_size")
    level = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("order", F.row_number().over(filling))
        .withColumn("full", F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce("full", F.lit(0))) / F.col("left"))
    )
    first = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("order")))
    return level.withColumn("level", first.over(everything)).select("source", "source_size", F.least(F.col("weight") * F.col("level"), cap.cast("double")).alias("target"))


def queued(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """row (a number of its own), doc_id, source, size, source_size, target, start (words of its source before it) of each
    row; checkpointed."""
    sized = cut(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).select(
            "*", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"), F.monotonically_increasing_id().alias("row")
        )
    )
    digits = F.substring("draw", 1, 3)
    per_bucket = sized.groupBy("source", digits.alias("bucket")).agg(F.sum("size").alias("words"))
    t = targets(sized, weights, share, repeats).alias("t")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").alias("o")
    offsets = offsets.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.bucket", "before", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("draw", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    own = sized.withColumn("bucket", digits).withColumn("upto", F.sum("size").over(within)).alias("s")
    o = offsets.alias("o")
    joined = own.join(o, F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.bucket") == F.col("o.bucket")))
    return cut(joined.select("row", "doc_id", "s.source", "size", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("start")))


def truncated(rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """row, doc_id, pass, finish, before (words of the mix before it), words: what the mix takes of queued() rows."""
    goal = F.floor("target").cast("long")
    budget = rows.groupBy("source").agg(F.max(goal).alias("goal")).agg(F.sum("goal")).first()[0] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, repeats * rows.count() // ROWS_PER_RANGE))
    part = lambda x, y: F.struct(x.alias("at"), y.alias("to"))
    first = F.col("start") + F.col("pass") * F.col("source_size")
    last = first + F.col("size")
    split = F.when((first < goal) & (goal < last), F.array(part(first, goal), part(goal, last))).otherwise(F.array(part(first, last)))
    parts = (
        rows.where("size > 0")
        .withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
        .withColumn("part", F.explode(split))
        .select("row", "doc_id", "source", "pass", "part.at", (F.col("part.to") - F.col("part.at")).alias("words"), (F.col("part.to") / F.col("target")).alias("finish"))
        .withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges + 1)).cast("long"))
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, MOST_RANGES at most
    bases = parts.groupBy("range").agg(F.sum("words").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(earlier), F.lit(0))).drop("all")
    ahead = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "at").rowsBetween(Window.unboundedPreceding, 0)
    in_order = parts.join(F.broadcast(bases.where(F.col("base") < budget)), "range").withColumn("before", F.col("base") + F.sum("words").over(ahead) - F.col("words"))
    return in_order.where(F.col("before") < budget).select("row", "doc_id", "pass", "finish", "before", F.least(F.col("words"), F.lit(budget) - F.col("before")).cast("long").alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), start (words of its source
    before it), first_finish (its virtual finish time in the first pass) and source of each row.

    The document at which a source reaches its target is cut there, so a source's taken words are its target rounded down."""
    rows = queued(docs, weights, share, repeats, seed)
    taken = truncated(rows, repeats).groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "start", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).alias("first_finish"), "source",
    )


def schedule(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, pass, finish, before, words: what the mix takes, in the global order of virtual finish times."""
    return truncated(queued(docs, weights, share, repeats, seed), repeats).drop("row").orderBy("before")


def resample(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it (taken words divided by its own, to the nearest, a half counting).

    Rows of one doc_id, source and size can't be told apart: they share what is taken of them all evenly, and a part of a
    time is rounded up or down by a draw for each row."""
    share = F.sum("taken") / (F.col("size") * F.count("*"))
    m = mix(docs, **options).where("size > 0").groupBy("doc_id", "source", "size").agg(share.alias("share"), F.count("*").alias("rows")).where("share > 0").alias("m")
    own, draw = unused(docs, "_size"), unused(docs, "_draw")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.withColumn(own, words).withColumn(draw, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col(f"d.{own}") == F.col("m.size"))
    times = F.floor(F.col("m.share") + F.when(F.col("m.rows") > 1, F.col(f"d.{draw}")).otherwise(0.5)).cast("int")
    joined = d.join(m, same).withColumn(unused(docs, "_time"), F.explode(F.array_repeat(F.lit(0), times)))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op1_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             ([5, 2, 1])[1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size / weight::DOUBLE AS ratio FROM s),
g AS (SELECT *, row_number() OVER o AS ord,
             coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_words,
             (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS left_weight,
             (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM f WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
h AS (SELECT *, (budget - full_words) / left_weight AS lev FROM g),
t AS (SELECT source, source_size, least(weight * (SELECT arg_min(lev, ord) FROM h WHERE lev <= ratio), (2 * source_size)::DOUBLE) AS target FROM h),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY draw, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
SELECT c.doc_id, c.size, t.source_size, t.target,
       (greatest(0, least(c.size, floor(target)::BIGINT - start)) + greatest(0, least(c.size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source"""
}
