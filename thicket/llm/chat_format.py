"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Services log a conversation again after every turn, so a log holds prefixes of its longer entries. Each turn's prefix hash
rolls on from the one before: it adds the hash of (place, role, text), twice over with different seeds, in halves whose
sums can't overflow. A conversation whose whole hash is another's proper prefix is dropped by an anti-join, equal
conversations are kept once (smallest conv_id), and what is maximal is rendered. Both sides of the anti-join are made
distinct before, so a first turn that a third of all conversations share is one row of it.

Turns count by (turn, role, text); null role or text counts as empty; null conv_id is one conversation like any other.
Repeated turns are turns. An empty table gives an empty result; further columns are ignored. A rendered conversation is
one row, so its turns meet in one task: the length of one conversation bounds it, not the number of its copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import cut, read

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
HASH = ["n", "s1", "s2", "s3", "s4"]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (place of the turn), s1..s4 (rolling hash up to it), turns (of the conversation) of each turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.xxhash64("n", "role", "text"), F.xxhash64(F.lit("second"), "text", "role", "n")
    half = F.lit(0xFFFFFFFF).cast("long")
    return (
        turns.withColumn("n", F.row_number().over(order))
        .withColumns({"a": a, "b": b})
        .withColumns({"s1": F.shiftrightunsigned("a", 32), "s2": F.col("a").bitwiseAND(half), "s3": F.shiftrightunsigned("b", 32), "s4": F.col("b").bitwiseAND(half)})
        .select("conv_id", "n", *[F.sum(c).over(upto).alias(c) for c in HASH[1:]], F.count("*").over(whole).alias("turns"))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations, itself included), rendered, of each maximal conversation."""
    empty = F.lit("")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    p = cut(prefixes(turns))
    whole = p.where("n = turns").groupBy(*HASH).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = p.where("n < turns").select(*HASH).distinct()
    kept = whole.join(proper, HASH, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")
    line = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END)),
    )
    shown = turns.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")))
    return shown.groupBy("t.conv_id", "n_turns", "copies").agg(F.array_join(line, "").alias("rendered")).select("conv_id", F.col("n_turns").cast("long"), "copies", "rendered")


def op6_chat_format(spark, sf_dir):
    return format_chats(read(spark, sf_dir, "conversations"))


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLE_SQL = {
    "op6_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, turn, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
             string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS said
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT said AS rendered, n AS n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c WHERE n = turns GROUP BY ALL)
SELECT conv_id, n_turns, copies, rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n < c.turns AND c.n = f.n_turns AND c.said = f.rendered)"""
}
