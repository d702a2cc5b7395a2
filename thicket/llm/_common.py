"""Helpers that the operators share: checkpoints, range buckets and joins that a hot key can't stall."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one row in HOT is hot, so there are never more than HOT hot keys.
HOT = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder: computed once, lineage cut, safe when executors go.

    The folder is the one that the session names in spark.checkpoint.dir. Where it is unset, a local session gets a folder of
    its own; on a cluster, whose machines don't share local folders, that is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Joins rows to groups, which has one row for each key and counts the rows of a key in `size`.

    Hot keys, at most HOT of them by their definition, are broadcast; the others go through a shuffle in which no key
    has more than a thousandth of the rows. rows and groups are read twice: pass them cut() or cheap. Rows whose key is
    null match nothing."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT > total)
    cold = groups.where(F.col(size) * HOT <= total)
    one = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return one.unionByName(rest.join(cold, key, how), allowMissingColumns=True)


def id_bounds(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most `buckets` - 1 ascending bounds that deal the rows of a numeric column out evenly."""
    if buckets < 2:
        return []
    return sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 1e-4)))


def buckets_of(spark: SparkSession) -> int:
    """As many buckets as the session deals a shuffle to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
