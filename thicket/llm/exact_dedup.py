"""Exact duplicates by content-defined chunk recipes.

Each normalised text (A-Z lower-cased, nothing else) is cut where the bytes themselves say so, each chunk gets a 64-bit
identifier that is verified against the chunk's SHA-256, and two texts are equal when their ordered lists of verified
identifiers are. The text itself is read once, where it lies; only identifiers (some 4 % of the bytes) are shuffled.

Null text counts as empty and so equals the empty text. Repeated rows of one doc_id are members of their group like any
other. A null doc_id never stays before one that is not null. An empty table gives an empty result; further columns of
the input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import cut, join_groups, read, unused
from thicket.llm._text import LOWER, by_bytes, texts

LEAST, MASK_BITS, MOST = 256, 10, 8192
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_K = np.uint64(0x9DDFEA08EB382D69)
_BLOCK = 1 << 20
SCHEMA = "doc_id long, text_sha256 string, keys array<long>, digests array<binary>"


def breaks(b: np.ndarray) -> np.ndarray:
    """Offsets behind every 8 bytes whose hash has MASK_BITS leading zeros."""
    found = []
    for at in range(0, max(0, len(b) - 7), _BLOCK):
        part = np.ascontiguousarray(b[at : at + _BLOCK + 7])
        w = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
        found.append(np.flatnonzero((w * _K) >> np.uint64(64 - MASK_BITS) == 0) + at + 8)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(start: int, end: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Chunks of [start, end) of LEAST to MOST bytes, the last one may be shorter; they depend on the content alone."""
    out, k, near = [], 0, cuts[np.searchsorted(cuts, start + LEAST) : np.searchsorted(cuts, end)].tolist()
    while end - start > LEAST:
        while k < len(near) and near[k] < start + LEAST:
            k += 1
        to = min(near[k] if k < len(near) else end, start + MOST, end)
        if to == end:
            break
        out.append((start, to))
        start = to
    if end > start:
        out.append((start, end))
    return out


def _recipes(id_bits: int):
    def run(batches):
        for batch in by_bytes(batches, 2 << 20):
            offs, data = texts(batch.column(1))
            low = LOWER[data[offs[0] : offs[-1]]]
            view, cuts, bounds = memoryview(low), breaks(low), (offs - offs[0]).tolist()
            shas, keys, digests = [], [], []
            for i in range(batch.num_rows):
                shas.append(hashlib.sha256(view[bounds[i] : bounds[i + 1]]).hexdigest())
                own = [view[a:z] for a, z in chunks(bounds[i], bounds[i + 1], cuts)]
                keys.append([(xxhash.xxh3_64_intdigest(c) >> (64 - id_bits)) - (1 << 63) * (id_bits == 64) for c in own])
                digests.append([hashlib.sha256(c).digest() for c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))],
                names=["doc_id", "text_sha256", "keys", "digests"],
            )

    return run


def verified_recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", id_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and recipe, the ordered list of verified chunk identifiers, of each row; checkpointed.

    A chunk's identifier is its 64-bit hash (id_bits of it, for tests). Where two different chunks share one, told by
    their SHA-256, the later ones get identifiers of their own, so equal lists mean equal texts."""
    rows = cut(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(_recipes(id_bits), SCHEMA))
    pairs = rows.select("doc_id", F.posexplode(F.arrays_zip("keys", "digests")).alias("pos", "c"))
    ranked = pairs.select("c.keys", "c.digests").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("keys").orderBy("digests")))
    clashes = cut(ranked.where("rank > 1"))
    if clashes.isEmpty():
        return rows.select("doc_id", "text_sha256", F.col("keys").alias("recipe"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    fixed = (
        cut(numbered)
        .select("row", F.posexplode(F.arrays_zip("keys", "digests")).alias("pos", "c"))
        .select("row", "pos", "c.keys", "c.digests")
        .join(clashes, ["keys", "digests"], "left")
        .select("row", F.struct("pos", F.concat_ws("/", "keys", F.coalesce("rank", F.lit(1))).alias("id")).alias("x"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("x")).alias("xs"))
        .select("row", F.col("xs.id").alias("recipe"))
    )
    return cut(numbered.join(fixed, "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", F.array().cast("array<string>")).alias("recipe")))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", id_bits: int = 64) -> DataFrame:
    """One row for each row: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256."""
    rows = verified_recipes(docs, id_column, text_column, id_bits)
    groups = cut(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return join_groups(rows, groups, "recipe", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with the columns of docs."""
    stay = cut(exact_dedup(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times")))
    again, sha = not stay.where("times > 1").isEmpty(), unused(docs, "_sha")
    low = F.translate(F.coalesce(docs["text"], F.lit("")), UPPER_AZ, LOWER_AZ)
    keyed = docs.withColumn(sha, F.sha2(low, 256)).alias("d")
    s = stay.alias("s")
    out = keyed.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{sha}") == F.col("s.text_sha256")), "left_semi")
    return (out.dropDuplicates(["doc_id", sha]) if again else out).drop(sha)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE_SQL = {
    "op10_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM t WINDOW w AS (PARTITION BY low)"""
}
