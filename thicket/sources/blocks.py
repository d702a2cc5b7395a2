"""Matched numeric blocks as relations: reading, checking, dictionaries, connections.

The canonical form is long: block, sample_idx, feature, feature_idx, value. Sample order is data (sample_idx), never the
order of rows. Files are read by spark.read, so column pruning and filters reach the scan; results are written by
df.write, as whatever format the session supports."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The patterns that tell a block's kind by its lower-cased name, the first that fits.
KINDS = (
    (r"mirna|micro.?rna", "mirna"),
    (r"meth|methyl|dnam|cpg|450k|850k", "methylation"),
    (r"protein|rppa|prot\b", "protein"),
    (r"rna|mrna|gene|expr|transcript", "rna"),
)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, kind: str = "parquet") -> DataFrame:
    df = spark.read.format(kind).load(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def from_arrays(df: DataFrame, id_column: str, array_column: str, blocks: dict[str, tuple[int, int]]) -> DataFrame:
    """Long form of a column of equal-length arrays; blocks: name -> [first, last) places. One narrow pass, no shuffle."""
    name = None
    for block, (first, last) in blocks.items():
        own = F.when((F.col("dim") >= first) & (F.col("dim") < last), F.lit(block))
        name = own if name is None else F.coalesce(name, own)
    long = df.select(F.col(id_column).alias("sample_idx"), F.posexplode(array_column).alias("dim", "value"))
    return long.select(name.alias("block"), "sample_idx", F.concat(F.lit("f"), "dim").alias("feature"), F.col("dim").alias("feature_idx"), F.col("value").cast("double").alias("value")).where("block IS NOT NULL")


def from_wide(df: DataFrame, block: str, id_column: str, columns: list[str] | None = None) -> DataFrame:
    """Long form of a wide table; refuses columns that aren't numbers."""
    columns = columns or [c for c in df.columns if c != id_column]
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if not kinds[c].startswith(NUMERIC)]
    if not columns or wrong:
        raise ValueError(f"block {block}: " + (f"columns {wrong} aren't numeric" if wrong else "it has no columns"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_idx"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.lit(block).alias("block"), F.col(id_column).alias("sample_idx"), F.inline(pairs))


def check_block(df: DataFrame, block: str, id_column: str, columns: list[str] | None = None) -> DataFrame:
    """df, or ValueError if it has under two rows, missing or repeated ids, or values that aren't finite: one aggregate."""
    columns = columns or [c for c in df.columns if c != id_column]
    from_wide(df.limit(0), block, id_column, columns)
    odd = [F.sum(F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) | (F.abs(F.col(f"`{c}`").cast("double")) == math.inf), 1).otherwise(0)) for c in columns]
    rows, ids, named, bad = df.agg(F.count("*"), F.count_distinct(id_column), F.count(id_column), sum(odd[1:], odd[0])).first()
    if rows < 2:
        raise ValueError(f"block {block}: two rows are needed at least")
    if named < rows or ids < rows:
        raise ValueError(f"block {block}: sample ids must be there and each once")
    if bad:
        raise ValueError(f"block {block}: {bad} values are missing or not finite")
    return df


def alignment(dictionaries: DataFrame) -> DataFrame:
    """block_a, block_b, only_a, only_b, moved of each pair of blocks of (block, sample_idx, sample_id): all 0 if aligned."""
    a, b = dictionaries.alias("a"), dictionaries.alias("b")
    sizes = dictionaries.groupBy("block").count()
    both = a.join(b, F.col("a.sample_id") == F.col("b.sample_id")).where("a.block < b.block").groupBy(F.col("a.block").alias("block_a"), F.col("b.block").alias("block_b"))
    shared = both.agg(F.count("*").alias("shared"), F.sum(F.when(F.col("a.sample_idx") != F.col("b.sample_idx"), 1).otherwise(0)).alias("moved"))
    x, y = (sizes.select(F.col("block").alias(f"block_{s}"), F.col("count").alias(f"n_{s}")) for s in "ab")
    pairs = x.join(y, F.col("block_a") < F.col("block_b")).join(shared, ["block_a", "block_b"], "left").fillna(0)
    return pairs.select("block_a", "block_b", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"), "moved")


def require_aligned(dictionaries: DataFrame) -> None:
    for a, b, only_a, only_b, moved in alignment(dictionaries).where("only_a + only_b + moved > 0").limit(1).collect():
        raise ValueError(f"blocks {a} and {b} hold " + ("other samples" if only_a + only_b else "the same samples in another order"))


def kind_of(name: str) -> str:
    return next((kind for pattern, kind in KINDS if re.search(pattern, name.lower())), "unknown")


def to_matrix(long: DataFrame) -> tuple[np.ndarray, list, list[str]]:
    """Matrix, samples and features of one block; for kernels that take a whole block, so samples x features must fit."""
    got = long.select("sample_idx", "feature", "feature_idx", "value").toPandas()
    wide = got.pivot(index="sample_idx", columns="feature_idx", values="value").sort_index()
    names = got.drop_duplicates("feature_idx").set_index("feature_idx")["feature"]
    return wide.to_numpy(float), wide.index.tolist(), [names[c] for c in wide.columns]


def ordered_pairs(blocks: list[str]) -> list[tuple[str, str]]:
    """(response, predictor): every ordered pair; a single block answers to itself."""
    return list(itertools.permutations(blocks, 2)) or [(b, b) for b in blocks]


def connections(blocks: DataFrame) -> DataFrame:
    """The same as a relation, from (block, place)."""
    a, b = (blocks.select(F.col("block").alias(n), F.col("place").alias(f"{n}_place")) for n in ("response", "predictor"))
    many = a.join(b, F.col("response") != F.col("predictor"))
    one = a.crossJoin(blocks.agg(F.count("*").alias("n")).where("n = 1")).select("response", "response_place", F.col("response").alias("predictor"), F.col("response_place").alias("predictor_place"))
    return many.unionByName(one).withColumn("conn_id", F.row_number().over(Window.orderBy("response_place", "predictor_place")) - 1)


def named_connections(wanted: list, blocks: list[str]) -> list[tuple[str, ...]]:
    """Connections given as names, pairs or response_predictor labels; blocks may have underscores of their own."""
    out = []
    for w in wanted:
        if isinstance(w, str):
            found = [p for p in ordered_pairs(blocks) if "_".join(p) == w] + ([(w,)] if w in blocks else [])
            if len(found) != 1:
                raise ValueError(f"connection {w!r} names {'no' if not found else 'more than one'} pair of blocks")
            out.append(found[0])
        else:
            w = tuple(w)
            if len(w) not in (1, 2) or set(w) - set(blocks):
                raise ValueError(f"connection {w!r} must name one or two of {blocks}")
            out.append(w)
    return out


def display_names(pairs: list[tuple[str, ...]]) -> list[str]:
    """response_predictor, with .1, .2 behind repeats."""
    seen: dict[str, int] = {}
    out = []
    for p in pairs:
        name = "_".join(p)
        seen[name] = seen.get(name, -1) + 1
        out.append(name + f".{seen[name]}" * bool(seen[name]))
    return out
