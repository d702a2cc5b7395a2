"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie; only (doc_id, piece, start, length, crc) rows go on. Pieces of one length, and gaps
of one size, are interchangeable, so both are kept as runs (one run of pieces for each length: 2048 rows whatever the corpus), and
the match of runs is a loop on the driver, not supersteps over rows (the README says why). A step takes the longest run of pieces,
goes to the least gap that holds it (its successor), settles who gets which gap by rank (the k-th piece gets the k-th place), cuts
the gaps' runs accordingly and repeats; what finds no gap opens new sequences. The result is that of sequential best-fit
decreasing. The pieces themselves are ranked within their length and placed by a range join with the matched runs, all
distributed; a length that a third of the pieces share is ranked in buckets.

Null and empty texts are one piece of the closing token. A doc_id that repeats, or is null, gives pieces for each row.
An empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import buckets_of, cut, read
from thicket.llm._text import by_bytes

SIZE = 2048
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
BROADCAST_ROWS = 200_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None):
    """text -> ids of the tokenizer at json_path. ranks_path: the same vocabulary as ranks, for the faster library; used
    once it agrees on a probe, and never for texts that hold a special token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    exact = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "It's  Été, naïve\n\n12½ \t çà 'll — 汉字 🙂 x y !!"

    def both(text):
        if any(s in text for s in special):
            return exact(text)
        return np.asarray(quick.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return both if np.array_equal(both(probe), exact(probe)) else exact


def _pieces(json_name: str, ranks_name: str, size: int, closing: int):
    def run(batches):
        encode = encoder(vocabulary(json_name), vocabulary(ranks_name) if ranks_name else None)
        for batch in by_bytes(batches):
            out = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(closing)).astype("<u4")
                first = len(ids) % size or size
                ends = [*range(min(first, len(ids)), len(ids) + 1, size)]
                for k, end in enumerate(ends):
                    at = max(0, end - size) if k else 0
                    for column, value in zip(out, (doc, k, at, end - at, zlib.crc32(ids[at:end].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def matched_runs(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence_from, per_sequence, offset) from the number of pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    filled, opened, out = 0, 0, []  # filled: bit g is set if there are gaps of size g

    def put(gap: int, run: tuple[int, int]) -> None:
        nonlocal filled
        if gap > 0 and run[1] > 0:
            gaps.setdefault(gap, []).append(run)
            filled |= 1 << gap

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            above = filled >> length
            if above:
                gap = length + (above & -above).bit_length() - 1
                at, have = gaps[gap].pop()
                if not gaps[gap]:
                    filled &= ~(1 << gap)
            else:
                gap, per = size, size // length
                at, have = opened, -(-left // per)
                opened += have
            per = gap // length
            use = min(have, left // per)
            if use:
                out.append((length, rank, rank + use * per, at, per, size - gap))
                put(gap - per * length, (at, use))
            rank, left = rank + use * per, left - use * per
            if use < have and left and left < per:
                out.append((length, rank, rank + left, at + use, left, size - gap))
                put(gap - left * length, (at + use, 1))
                rank, left, use = rank + left, 0, use + 1
            put(gap, (at + use, have - use))
    return out


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (doc_id, piece, length, ...), checkpointed, with sequence_id and offset."""
    spark = pieces.sparkSession
    buckets = buckets_of(spark)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = cut(dealt.groupBy("length", "bucket").count())
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    plan = matched_runs({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, size)
    runs = spark.createDataFrame(plan, "run_length long, rank_from long, rank_to long, sequence_from long, per_sequence long, run_offset long")
    runs = F.broadcast(runs) if len(plan) <= BROADCAST_ROWS else runs
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(runs, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    k = F.col("rank") - F.col("rank_from")
    return placed.select(
        *pieces.columns,
        (F.col("sequence_from") + F.floor(k / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (k % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, size: int = SIZE, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken", closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pack(cut(text.mapInArrow(_pieces(json_name, ranks_name, size, closing), SCHEMA)), size)


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
