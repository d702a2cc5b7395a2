"""Rows of leaf weights: the same as by a join of pairs, and no pairs between tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions.rng import Stream
from thicket.operators import forest, importance, leaves
from thicket.operators import matrix as X
from thicket.plans import catalogue

PAIRS = ["fw_all", "row_normalize"]
TOP = ["topv_ties", "topv_strict", "prepare_weight", "row_entropy", "fused_entropy", "sim_second", "sim_first", "knn_sparsify", "laplacian", "modularity_score", "network_edges", "chord_pairs", "tune_subset", "recon_matmul", "bench_second_order", "fuse_response", "fuse_global_avg", "fuse_global_pmin", "residual", "shared_frac", "candidate_entropies"]


def membership(spark, n=60, trees=7):
    """Leaves of several sizes; some samples are missing in trees, some rows are without a leaf, some are drawn twice."""
    rng = np.random.default_rng(3)
    rows = [(t, 10 * i, None if rng.random() < 0.05 else int(rng.integers(-2, 4)), int(rng.integers(0, 3))) for t in range(trees) for i in range(n) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "tree int, sample_idx int, leaf int, inbag int")


def same(a, b):
    x, y = ({(r["i"], r["j"]): r["w"] for r in d.collect()} for d in (a, b))
    assert set(x) == set(y) and x
    assert max(abs(x[k] - y[k]) for k in x) < 1e-15
    assert a.schema == b.schema or [f.dataType for f in a.schema] == [f.dataType for f in b.schema]


@pytest.mark.parametrize("mode", ["all", "inbag", "oob"])
def test_rows_are_those_of_the_join(spark, mode, monkeypatch):
    m = membership(spark)
    rows = leaves.forest_weights(m, mode)
    assert "Join" not in rows._jdf.queryExecution().toString()
    monkeypatch.setattr(leaves, "LEAF_BYTES", 0)
    joined = leaves.forest_weights(m, mode)
    assert "Join" in joined._jdf.queryExecution().toString()
    same(rows, joined)


def test_samples_that_come_twice_are_joined(spark):
    m = membership(spark)
    assert leaves._leaf_rows(m, "all") is not None and leaves._leaf_rows(m.unionByName(m.limit(1)), "all") is None


@pytest.mark.parametrize("name", PAIRS)
def test_all_pairs_are_not_shuffled(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan


def test_top_keeps_ties_and_the_diagonal(spark):
    m = membership(spark, 200, 5)
    whole, top = leaves.forest_weights(m), leaves.forest_weights(m, top=4)
    assert top.count() < whole.count() / 2 and top.where("i = j").count() == whole.where("i = j").count()
    for ties in (True, False):
        same(X.prepare(whole, 4, ties=ties), X.prepare(top, 4, ties=ties))


@pytest.mark.parametrize("name", TOP)
def test_only_what_is_kept_reaches_the_shuffle(spark, sf, name, monkeypatch):
    seen, adjust = [], X.adjust
    monkeypatch.setattr(X, "adjust", lambda w, *args, **more: seen.append(w.count()) or adjust(w, *args, **more))
    catalogue.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert seen and max(seen) < n * n / 4


@pytest.mark.parametrize("mode", ["all", "inbag", "oob"])
def test_errors_without_weights(spark, mode):
    m, rng = membership(spark), np.random.default_rng(5)
    rows = [("A", 10 * i, f"f{k}", float(rng.normal())) for i in range(55) for k in range(3) if rng.random() < 0.8]
    long = spark.createDataFrame(rows, "block string, sample_idx int, feature string, value double")
    got, want = (d.first()[0] for d in (leaves.forest_nmse(m, long, mode), leaves.nmse(leaves.forest_weights(m, mode), long)))
    assert abs(got - want) < 1e-12 * want


@pytest.mark.parametrize("name", ["oob_nmse", "r_squared_error"])
def test_errors_need_no_weights(spark, sf, name, monkeypatch):
    monkeypatch.delattr(leaves, "forest_weights")
    assert catalogue.QUERIES[name](spark, sf).first()[0] > 0


@pytest.mark.parametrize("constant", [False, True])
def test_responses_of_clusters_are_those_of_split_statistics(spark, constant):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(240, 4)), rng.normal(size=(240, 5)) + 100
    if constant:
        y[:, [0, 3]] = 0.1
    f = forest.fit(spark, x, y, forest.Control(trees=3, nodesize=6))
    labels = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(230)], "sample_idx int, cluster string")
    got = {(r["cluster"], r["var"]): r["imd"] for r in importance.cluster_imd(f, labels)[0].where("side = 'Y'").collect()}
    long = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(y) for k, v in enumerate(row)], "sample_idx int, response int, y double")
    at = importance.node_samples(f.nodes, f.membership, importance.leaf_ancestors(f.nodes)).join(labels, "sample_idx").join(long, "sample_idx")
    stats = importance.split_statistics(at.select(F.struct("cluster", "tree", "node").alias("node"), "response", "side", "y")).where("stat > 0")
    best = stats.groupBy("node").agg(F.max_by("response", F.struct("stat", -F.col("response"))).alias("var")).select("node.*", "var").join(f.nodes.select("tree", "node", "depth"), ["tree", "node"])
    want = best.groupBy("cluster", "tree", "var").agg((1 / (F.min("depth") + 1)).alias("d")).groupBy("cluster", "var").agg((F.sum("d") / 3).alias("imd"))
    assert got == {(r["cluster"], r["var"]): pytest.approx(r["imd"]) for r in want.collect()} and got


def test_cluster_importance_does_not_repeat_samples(spark, monkeypatch):
    monkeypatch.delattr(importance, "node_samples")
    x = np.random.default_rng(7).normal(size=(80, 3))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "sample_idx int, cluster int")
    assert importance.cluster_imd(forest.fit(spark, x, x[:, ::-1].copy(), forest.Control(trees=2)), labels)[0].count() > 0


def test_few_draws_do_not_copy_the_pool():
    class Pool:
        reads = 0

        def __len__(self):
            return 1000

        def __getitem__(self, k):
            self.reads += 1
            if k >= 1000:
                raise IndexError
            return 7 * k

    def plain(stream, pool, size):
        pool, out = list(pool), []
        for left in range(len(pool), len(pool) - size, -1):
            at = stream.index(left)
            out.append(pool[at])
            pool[at] = pool[left - 1]
        return out

    pool = Pool()
    assert Stream(-11).without_replacement(pool, 5) == plain(Stream(-11), range(0, 7000, 7), 5) and pool.reads == 5
    a, b = Stream(-4), Stream(-4)
    assert a.without_replacement(range(50), 50) == plain(b, range(50), 50) and a.unit() == b.unit()


def test_sub_forests_share_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 40)), rng.normal(size=(60, 30))
    monkeypatch.setattr(forest, "MATRIX_BYTES", x.nbytes + y.nbytes)
    parts = forest.fit_subsampled(spark, x, y, n_sub=3, trees=2)
    for p in parts:
        alone = forest.fit(spark, x[:, p["x_columns"]], y[:, p["y_columns"]], p["forest"].control)
        assert sorted(alone.membership.select("tree", "sample_idx", "leaf").collect()) == sorted(p["forest"].membership.select("tree", "sample_idx", "leaf").collect())
