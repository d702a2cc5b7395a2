"""The stages in a row on the smallest tables, each held against its own input."""

from collections import Counter

import corpus_pipeline
from thicket.llm import best_fit_packing, minhash_dedup

from tests.llm.test_operators import AZ, brute_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        seen.append(out.collect())
        docs = spark.createDataFrame(seen[-1], out.schema)
    start, named, exact, near, mixed, packed = seen
    assert len(named) >= 0.98 * len(start)
    low = lambda r: (r["text"] or "").translate(AZ)
    assert Counter(map(low, exact)) == Counter({low(r): 1 for r in named})
    assert {r["doc_id"] for r in exact} == {max(x["doc_id"] for x in named if low(x) == low(r)) for r in exact}
    data = [(r["doc_id"], r["text"]) for r in exact]
    assert {r["doc_id"] for r in near} == set(brute_components(data, minhash_dedup.SHINGLE))
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in near} and max(times.values()) <= 2
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(near)) < 0.2 * words(near)
    assert sum(r["length"] for r in packed if r["piece"] == 0) and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= 1.05 * total / best_fit_packing.SIZE + 1


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
