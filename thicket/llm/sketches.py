"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its runs of five words (the whole sequence if it has fewer words, none without words), hashed to 64
bits. Its sketch is the K smallest distinct hashes. Sketches merge: the sketch of a union is the K smallest of both, so
parts of a text, or of a corpus, can be sketched apart. Two sketches give resemblance, containment and distinct counts;
with fewer than K shingles all of them are exact.

The fingerprint is the sketch as base64 of big-endian numbers in ascending order, so equal texts have equal ones. Two
empty sketches resemble each other fully, an empty and another one not at all.

The query also edits each text with the one after it by doc_id, which costs one shuffle of the texts: rows go to fixed
ranges of doc_id, each range also gets the first row of the next one, and each is read as a stream in order. Null texts
count as empty; null doc_ids come last; rows of one doc_id go by their text. An empty table gives an empty result;
further columns are ignored."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._common import buckets_of, id_bounds, read
from thicket.llm._text import by_bytes, shingle_set, texts, words_by_text

K, SHINGLE, EDIT = 128, 5, 4
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_in_edited double, distinct_shingles double"
)


def sketches(column: pa.Array, size: int = SHINGLE, k: int = K) -> list[np.ndarray]:
    return [shingle_set(w, size)[:k] for _, w in words_by_text(*texts(column))]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what a and b are sketches of."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    same = np.append(both[1:] == both[:-1], False)
    union = np.append(True, both[1:] != both[:-1])
    at = np.flatnonzero(union)[:k]
    return float(same[at].sum()) / len(at)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """text, its last quarter replaced by as much of the beginning of the following one."""
    n = len(text) // EDIT
    return text[: len(text) - n] + following[:n] if n else text


def _neighbours(batches):
    """Rows (doc_id, text, carried) in order; a carried row only follows."""
    held = None  # doc_id, text, sketch of the last own row
    for batch in by_bytes(batches, 4 << 20):
        ids, own = batch.column(0).to_pylist(), [not c for c in batch.column(2).to_pylist()]
        column = batch.column(1)
        rows = list(zip(ids, [t or "" for t in column.to_pylist()], sketches(column), own, strict=True))
        pairs = []
        for row in rows:
            if held:
                pairs.append((held, row))
            held = row if row[3] else None
        new = [edited(a[1], b[1]) for a, b in pairs]
        of_new = sketches(pa.array(new, pa.large_string()))
        out = [
            (a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), encode(a[2]), encode(s), resemblance(a[2], s), resemblance(a[2], b[2]), containment(a[2], s), distinct_count(a[2]))
            for (a, b), e, s in zip(pairs, new, of_new, strict=True)
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for k in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 1000], strict=True), kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """SCHEMA's columns for each row; the next document of the last one is the first."""
    spark = docs.sparkSession
    big = F.lit((1 << 63) - 1).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("place", F.coalesce("doc_id", big))
    tasks = buckets_of(spark)
    bounds = id_bounds(d, "place", 4 * tasks)
    deal = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="place", outputCol="bucket")  # a search in an array, whatever its length
    d = (deal.transform(d) if bounds else d.withColumn("bucket", F.lit(0))).withColumn("bucket", F.col("bucket").cast("int"))
    firsts = sorted(d.groupBy("bucket").agg(F.min("place")).collect())  # a row for each bucket
    if not firsts:
        return d.select("doc_id", "text", F.lit(False).alias("carried")).mapInArrow(_neighbours, SCHEMA)
    sent = spark.createDataFrame([(place, firsts[i - 1][0]) for i, (_, place) in enumerate(firsts)], "place long, to int")
    own, carried = (F.struct(F.col(c).alias("bucket"), F.lit(x).alias("carried")) for c, x in (("bucket", False), ("to", True)))
    goes = F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, carried)))
    dealt = d.join(F.broadcast(sent), "place", "left").withColumn("goes", goes).select("doc_id", "text", "goes.carried", F.col("goes.bucket").alias("_bucket"), "place")
    rows = dealt.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", "carried", "place", "text")
    return rows.select("doc_id", "text", "carried").mapInArrow(_neighbours, SCHEMA)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row, without neighbours and without a shuffle."""

    def run(batches):
        for batch in by_bytes(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in sketches(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def op8_sketches(spark, sf_dir):
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op8_sketches": op8_sketches}
ORACLE_SQL: dict[str, str] = {}
