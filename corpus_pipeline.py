"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing, each over all that the one before kept.

Near-duplicates are linked at five words and a similarity of 0.8; the document with the least doc_id of each group stays.
The language stage drops documents that are `und` (null, or without a letter), the mix repeats documents up to twice."""

from __future__ import annotations

from thicket.llm import best_fit_packing, exact_dedup, language_id, minhash_dedup, mixing


def language(spark, docs, sf_dir):
    return language_id.keep_identified(docs, language_id.train(docs))


def exact(spark, docs, sf_dir):
    return exact_dedup.keep_one(docs)


def near(spark, docs, sf_dir):
    return minhash_dedup.keep_one(docs)


def mix(spark, docs, sf_dir):
    return mixing.resample(docs)


def pack(spark, docs, sf_dir):
    return best_fit_packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: Suffix automata, MinHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES over documents; each stage's rows are written to the checkpoint folder and read from there by the next."""
    from thicket.llm._common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
