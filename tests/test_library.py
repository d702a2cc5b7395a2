"""Contracts of the forest library: kernels against plain re-derivations, relations against small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import cluster as C
from thicket.functions import stats, tree
from thicket.functions.mixture import fit_mixture
from thicket.functions.rng import Stream, seed_chain
from thicket.functions.tsne import gradient, probabilities, tsne
from thicket.operators import filtering, forest, fusion, importance, leaves, metrics, reports, selection, simulate, tuning
from thicket.operators import matrix as X
from thicket.plans import pipeline
from thicket.sources import blocks as B
from thicket.sources import checks


def coo(spark, m, **keys):
    rows = [(*keys.values(), i, j, float(v)) for i, r in enumerate(np.asarray(m)) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, ", ".join([*(f"{k} string" for k in keys), "i int", "j int", "w double"]))


def back(df, n):
    return pipeline.dense(df, n)


# streams and trees


def test_streams_repeat_and_stay_in_range():
    a, b = Stream(-529), Stream(-529)
    u = [a.unit() for _ in range(2000)]
    assert u == [b.unit() for _ in range(2000)] and 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
    assert sorted(Stream(-3).without_replacement(range(9), 9)) == list(range(9))
    assert Stream(-3).weighted(range(4), [0, 2.0, 0, 0], 3) == [1]
    x, y = seed_chain(529, 5)
    assert len(set(x + y)) == 10 and all(s < 0 for s in x + y) and seed_chain(529, 5) == (x, y)


def exhaustive(x, y, rows):
    best = (-1.0,)
    z = y[rows]
    z = (z - z.mean(0)) / np.sqrt(((z - z.mean(0)) ** 2).mean(0))
    for var in range(x.shape[1]):
        for cut in np.unique(x[rows, var])[:-1]:
            left = x[rows, var] <= cut
            s = z[left].sum(0)
            part = s**2 / left.sum() + s**2 / (~left).sum()
            if part.mean() > best[0] + 1e-9:
                best = (part.mean(), var, cut, int(part.argmax()))
    return best


@pytest.mark.parametrize("repeats", [False, True])
def test_stump_is_the_best_of_all_cuts(repeats):
    r = np.random.default_rng(1)
    x = r.normal(size=(48, 4))
    y = np.stack([x[:, 0] > 0, x[:, 1], x[:, 2] + x[:, 0]], 1) + 0.3 * r.normal(size=(48, 3))
    rows = tree.bag_of(48, repeats, Stream(-7))
    var, cut, score, msrv, parts = tree.best_split(x, y, rows, 4, 3, 0, Stream(-11))
    want = exhaustive(x, y, rows)
    assert (score, var, cut, msrv) == (pytest.approx(want[0]), want[1], want[2], want[3]) and set(parts) == {0, 1, 2}


def test_trees_hold_their_contract():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(60, 5)), r.normal(size=(60, 4))
    c = forest.Control(trees=3, nodesize=4, max_depth=3)
    for t in range(3):
        g, leaf, draws = forest.grow_one(x, y, c, t, seed_chain(529, 3))
        again = forest.grow_one(x, y * 1e-5, c, t, seed_chain(529, 3))[0]
        assert (g.var, g.cut, g.left) == (again.var, again.cut, again.left)
        assert draws.sum() == round(0.632 * 60) and draws.max() == 1
        for k, (a, b) in enumerate(zip(g.left, g.right, strict=True)):
            if a >= 0:
                assert g.size[a] + g.size[b] == g.size[k] >= 8 and g.depth[a] == g.depth[k] + 1 <= 3
        assert all(g.left[v] < 0 for v in leaf)
        assert sorted(g.preorder_leaves().values()) == list(range(1, sum(v < 0 for v in g.left) + 1))
    weighted = forest.Control(trees=8, max_depth=1, x_weights=(0, 1.0, 0, 0, 0), y_weights=(0, 0, 0, 1.0), mtry=5, ytry=4)
    for t in range(8):
        g = forest.grow_one(x, y, weighted, t, seed_chain(529, 8))[0]
        assert g.var[0] == 1 and g.msrv[0] == 3


def test_constant_responses_and_bad_input(spark):
    x = np.arange(10.0)[:, None]
    assert tree.best_split(x, np.ones((10, 1)), np.arange(10), 1, 1, 0, Stream(-1)) is None
    for bad in (np.ones((1, 2)), np.full((3, 2), np.nan), np.ones(4)):
        with pytest.raises(ValueError):
            forest.check_matrix(bad, "X")
    for bad in ({"trees": 0}, {"nsplit": -1}, {"nodesize": 1.5}, {"trees": True}):
        with pytest.raises(ValueError):
            forest.Control(**bad).check()
    assert forest.resolve("sqrt(p) + 1", 16, "p/3") == 5 and forest.resolve(None, 10, "p/3") == 4
    for bad in ("__import__('os')", "q", "p.real", -1, "0*p"):
        with pytest.raises((ValueError, SyntaxError)):
            forest.resolve(bad, 4, "p/3")


@pytest.fixture(scope="module")
def grown(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(36, 4))
    y = np.hstack([x[:, :2] + 0.5 * r.normal(size=(36, 2)), r.normal(size=(36, 1))])
    f = forest.fit(spark, x, y, forest.Control(trees=7, nodesize=3, nsplit=4, max_depth=3, with_replacement=True))
    f.nodes, f.membership = f.nodes.cache(), f.membership.cache()
    return f


def arrays(f):
    m = f.membership.toPandas()
    return (m.pivot(index="sample_idx", columns="tree", values=c).to_numpy() for c in ("leaf", "inbag"))


@pytest.mark.parametrize("mode", ["all", "inbag", "oob"])
def test_weights_and_proximities(grown, mode):
    leaf, bag = arrays(grown)
    n, trees = leaf.shape
    w, count = np.zeros((n, n)), np.zeros(n)
    near, both = np.zeros((n, n)), np.zeros((n, n))
    for t in range(trees):
        mass = np.ones(n) if mode == "all" else bag[:, t].astype(float)
        ok = np.ones(n, bool) if mode == "all" else bag[:, t] > 0 if mode == "inbag" else bag[:, t] == 0
        both += np.outer(ok, ok)
        near += np.outer(ok, ok) * (leaf[:, t][:, None] == leaf[:, t])
        for i in range(n):
            donors = mass * (leaf[:, t] == leaf[i, t])
            if donors.sum() >= 1 and (mode != "oob" or bag[i, t] == 0):
                w[i] += donors / donors.sum()
                count[i] += 1
    got = back(leaves.forest_weights(grown.membership, mode), n)
    assert np.allclose(got, w / np.maximum(count, 1)[:, None])
    if mode != "oob":
        assert np.allclose(got.sum(1), 1)
    assert np.allclose(back(leaves.proximity(grown.membership, mode), n), np.divide(near, both, out=np.zeros((n, n)), where=both > 0))


def test_oob_rows_without_a_tree_are_absent(spark):
    m = spark.createDataFrame([(0, i, 1, 1) for i in range(3)], "tree int, sample_idx int, leaf int, inbag int")
    assert leaves.oob_weights(m).count() == 0
    bags = [(1, 1), (1, 0), (0, 1)]
    m = spark.createDataFrame([(t, i, 1, b[t]) for i, b in enumerate(bags) for t in (0, 1)], "tree int, sample_idx int, leaf int, inbag int")
    assert {tuple(r) for r in leaves.oob_weights(m).collect()} == {(1, 0, 0.5), (1, 2, 0.5), (2, 0, 0.5), (2, 1, 0.5)}


def test_enhanced_proximity(grown):
    leaf, _ = arrays(grown)
    n, trees = leaf.shape
    e = leaves.embeddings_of(grown)
    want = np.zeros((n, n))
    pairs = leaves.sibling_leaves(leaves.number_leaves(grown.nodes), grown.membership).collect()
    for t in range(trees):
        own = (leaf[:, t][:, None] == leaf[:, t]).astype(float)
        for tt, a, b in pairs:
            x, y = leaf[:, t] == a, leaf[:, t] == b
            if tt == t and x.any() and y.any():
                corr = np.mean([stats.spearman(m[x].mean(0), m[y].mean(0)) for m in e])
                own[np.ix_(x, y)] = own[np.ix_(y, x)] = min(1, 0.5 * max(corr, 0))
        want += own
    assert np.allclose(back(leaves.enhanced_of(grown), n), want / trees)


def test_importance(grown):
    nodes = grown.nodes.toPandas()
    for side, p in (("split_var", 4), ("msrv", 3)):
        want = np.zeros(p)
        for _, g in nodes[~nodes.is_leaf].groupby("tree"):
            for v in range(p):
                d = g.loc[g[side] == v, "depth"]
                want[v] += 1 / (d.min() + 1) / 7 if len(d) else 0
        vars_ = grown.nodes.sparkSession.range(p).select(F.col("id").cast("int").alias("var"))
        got = {r["var"]: r["imd"] for r in importance.forest_mean(importance.per_tree(grown.nodes, side), 7, vars_).collect()}
        assert np.allclose([got[v] for v in range(p)], want)


def test_classification(spark):
    r = np.random.default_rng(4)
    labels = ["A"] * 20 + ["B"] * 20
    x = r.normal(size=(40, 5)) + np.repeat([[0], [3]], 20, 0)
    f, levels = forest.fit_classes(spark, x, labels, forest.Control(trees=15, nodesize=1))
    classes = spark.createDataFrame(list(enumerate(labels)), "sample_idx int, class string")
    probs = forest.class_probabilities(leaves.forest_weights(f.membership), classes)
    assert all(abs(s - 1) < 1e-9 for _, s in probs.groupBy("i").agg(F.sum("prob")).collect())
    got = {r["i"]: r["predicted"] for r in forest.class_predictions(probs).collect()}
    assert np.mean([got[i] == c for i, c in enumerate(labels)]) > 0.9 and levels == ["A", "B"]


def test_cluster_importance_reads_the_clusters_samples(grown, spark):
    c = spark.createDataFrame([(i, int(i % 12 == 0)) for i in range(36)], "sample_idx int, cluster int")
    got, status = importance.cluster_imd(grown, c, least=20)
    assert {r["cluster"]: r["status"] for r in status.collect()} == {0: "ok", 1: "too small"}
    assert {r["cluster"] for r in got.collect()} == {0}
    whole = {r["var"]: r["imd"] for r in importance.per_tree(grown.nodes).groupBy("var").agg((F.sum("imd") / 7).alias("imd")).collect()}
    assert {r["var"]: pytest.approx(r["imd"]) for r in got.where("side = 'X'").collect()} == whole


# blocks


def test_blocks(spark):
    d = spark.createDataFrame([("s1", 1.0, 1.0, 3.0), ("s2", 2.0, 1.0, 9.0), ("s3", 4.0, 1.0, 27.0)], "id string, a double, c double, b double")
    assert B.check_block(d, "x", "id") is d
    kept, summary = filtering.filter_blocks(B.from_wide(d, "x", "id"), {"x": 1})
    assert {r["feature"] for r in kept.collect()} == {"b"} and summary.first()["varying"] == 2
    assert {r["feature"] for r in filtering.filter_blocks(B.from_wide(d, "x", "id"), {"x": math.inf})[0].collect()} == {"a", "b"}
    for bad in (d.limit(1), d.union(d), d.withColumn("a", F.lit(float("nan"))), d.withColumn("a", F.lit("x")), d.select("id")):
        with pytest.raises(ValueError):
            B.check_block(bad, "x", "id")
    z = filtering.zscore(B.from_wide(d, "x", "id", ["a", "b"])).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in z)
    names = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q"), ("b", 0, "q"), ("b", 1, "p")], "block string, sample_idx int, sample_id string")
    with pytest.raises(ValueError, match="order"):
        B.require_aligned(names)
    with pytest.raises(ValueError, match="other samples"):
        B.require_aligned(names.withColumn("sample_id", F.when(F.col("block") == "b", F.concat("sample_id", F.lit("x"))).otherwise(F.col("sample_id"))))


def test_names():
    assert [B.kind_of(n) for n in ("miRNA", "mRNA", "methy", "protein", "xyz")] == ["mirna", "rna", "methylation", "protein", "unknown"]
    assert filtering.default_top("methylation", 100) == 5000 and filtering.default_top("mirna", 200) == 1000
    assert B.named_connections(["a_b"], ["a", "b"]) == [("a", "b")] and B.ordered_pairs(["a"]) == [("a", "a")]
    for bad in (["a_b_c"], [("a", "q")]):
        with pytest.raises(ValueError):
            B.named_connections(bad, ["a_b", "c", "a", "b_c"])
    assert B.display_names([("a", "b"), ("a", "b")]) == ["a_b", "a_b.1"]
    assert filtering.tuning_size(600) == 600 and filtering.tuning_size(700) == 600 and filtering.tuning_size(9000) == 800


# matrices and fusion


def test_prepared_weights(spark):
    w = np.array([[0.5, 0.2, 0.2, 0.1], [0.1, 0.6, 0.3, 0.0], [0.25, 0.25, 0.25, 0.25], [0, 0, 0, 1.0]])
    got = back(X.prepare(coo(spark, w), 1), 4)
    assert np.allclose(got[0], [0, 0.5, 0.5, 0]) and np.allclose(got[1], [0, 0, 1, 0]) and np.allclose(got[3], 0)
    assert np.allclose(back(X.adjust(coo(spark, w)), 4)[0], [0, 0.4, 0.4, 0.2])
    s = back(X.second_order(coo(spark, w)), 4)
    want = w @ w.T
    np.fill_diagonal(want, 0)
    assert np.allclose(s, want)
    first = (w + w.T) / 2
    np.fill_diagonal(first, 0)
    assert np.allclose(back(X.first_order(coo(spark, w)), 4), first)
    e = {r["i"]: r["n_eff"] for r in X.row_entropy(coo(spark, w)).collect()}
    assert e[2] == pytest.approx(4) and e[3] == 1


def test_fusion_by_response(spark):
    mats = {m: v * np.eye(3) + (1 - v) / 3 for m, v in (("A_B", 0.9), ("A_C", 0.6), ("B_A", 0.3))}
    w = None
    for m, x in mats.items():
        one = coo(spark, x, model=m)
        w = one if w is None else w.unionByName(one)
    scores = spark.createDataFrame([("A_B", "A", 9.0), ("A_C", "A", 1.0), ("B_A", "B", 1.0)], "model string, response string, score double")
    fused = fusion.by_response(w, fusion.shares(scores))
    want = 0.5 * (0.9 * mats["A_B"] + 0.1 * mats["A_C"]) + 0.5 * mats["B_A"]
    assert np.allclose(back(fusion.overall(fused), 3), want)
    with pytest.raises(ValueError):
        fusion.overall(fused, responses=["A", "B", "C"])
    zero = fusion.shares(scores.withColumn("score", F.lit(0.0)))
    assert {r["model"]: r["alpha"] for r in zero.collect()} == {"A_B": 0.5, "A_C": 0.5, "B_A": 1.0}


def test_residual_and_shared_fraction(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(6, 2))
    w = 0.2 * np.eye(6) + 0.8 / 6
    long = spark.createDataFrame([("A", i, f"f{k}", float(v)) for i, row in enumerate(x) for k, v in enumerate(row)], "block string, sample_idx int, feature string, value double")
    rest = fusion.residual(long, coo(spark, w, response="A"))
    got = rest.toPandas().pivot(index="sample_idx", columns="feature", values="value").to_numpy()
    assert np.allclose(got, x - w @ x)
    assert fusion.shared_fraction(long, rest).first()["shared_frac"] == pytest.approx(1 - ((x - w @ x) ** 2).sum() / (x**2).sum())


# clusters


def blocks_similarity(sizes):
    label = np.repeat(np.arange(len(sizes)), sizes)
    s = np.where(label[:, None] == label, 0.9, 0.1)
    np.fill_diagonal(s, 1)
    return s, label


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_spectral_and_pam():
    s, label = blocks_similarity([5, 6, 4])
    assert C.spectral(s)["k"] == 3 and same_partition(C.spectral(s)["labels"], label)
    got = C.pam_tuned(1 - s, range(2, 6))
    assert got["k"] == 3 and same_partition(got["labels"], label)
    assert C.pam_tuned(1 - s, range(2, 6), "ratio")["k"] in range(2, 7)
    with pytest.raises(ValueError):
        C.k_grid([1, 99], 5)
    d = C.distances(np.random.default_rng(1).normal(size=(12, 2)))
    labels, medoids, cost = C.pam(d, 2)
    best = min(np.minimum(d[:, a], d[:, b]).mean() for a in range(12) for b in range(a))
    assert cost == pytest.approx(best, rel=0.05)
    assert (labels[medoids] == np.arange(2)).all()


def test_louvain_modularity_and_alternation():
    s, label = blocks_similarity([6, 6])
    np.fill_diagonal(s, 0)
    assert same_partition(C.louvain(s), label) and C.modularity(s, label) > 0.3 and C.weight_modularity(np.eye(4)) == 0
    w = [np.where(label[:, None] == label, 1 / 6, 0.0), np.full((12, 12), 1 / 12)]
    got = C.fuse_alternating(w, 2, gamma=0.01, start=[0.6, 0.4])
    lap = [C.laplacian_of_weights(x)[1] for x in w]
    u = np.linalg.eigh(sum(a * x for a, x in zip(got["shares"], lap, strict=True)))[1][:, :2]
    assert np.allclose(u @ u.T, got["embedding"] @ got["embedding"].T) and got["shares"].sum() == pytest.approx(1)


def test_metrics(spark):
    def of(a, b):
        return metrics.agreement(spark.createDataFrame(list(zip(a, b, strict=True)), "pred int, ref int")).first()

    same = of([1, 1, 2, 2], [3, 3, 4, 4])
    assert same["ari"] == same["jaccard"] == same["purity"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    r = np.random.default_rng(2)
    a, b = r.integers(0, 3, 40), r.integers(0, 4, 40)
    got = of(a.tolist(), b.tolist())
    x, y = (np.equal.outer(v, v)[np.triu_indices(40, 1)] for v in (a, b))
    assert got["jaccard"] == pytest.approx((x & y).sum() / (x | y).sum())
    e = x.sum() * y.sum() / len(x)
    assert got["ari"] == pytest.approx(((x & y).sum() - e) / ((x.sum() + y.sum()) / 2 - e))
    assert of([1, None, 1, 2], [1, 1, None, 2])["n"] == 2
    assert of([1, 1, 1], [1, 1, 1])["ari"] is None


# selection


def test_selection_rules(spark):
    imd = spark.createDataFrame([("b", f, v) for f, v in zip("abcd", (0.05, 0.1, 0.4, 0.8), strict=True)], "block string, feature string, imd double")
    assert {r["feature"] for r in selection.by_threshold(imd, 1.0).where("selected").collect()} == {"c", "d"}
    trees = spark.createDataFrame([("b", f, t, v) for f, row in (("x", [0.9, 0.8, 0.9, 1.0, 0.9]), ("y", [0.1, 0.2, 0.0, 0.1, 0.1]), ("z", [0.2] * 5)) for t, v in enumerate(row)], "block string, feature string, tree int, imd double")
    got = {r["feature"]: r["selected"] for r in selection.by_t_test(trees).collect()}
    assert got == {"x": True, "y": False, "z": False}
    votes = spark.createDataFrame([("m1", "b", "f", True), ("m2", "b", "f", False), ("m1", "b", "g", True), ("m2", "b", "g", True)], "model string, block string, feature string, keep boolean")
    every = spark.createDataFrame([("b", "f"), ("b", "g"), ("c", "h")], "block string, feature string")
    assert {r["feature"]: r["selected"] for r in selection.majority(votes, every).collect()} == {"f": False, "g": True, "h": True}
    assert selection.plateau([0.505, 0.6, 0.601]) == 1 and selection.plateau([0.5, 0.7, 0.4]) == 2
    fake = selection.adaptive({"b": {"p": 0.1, "q": 0.9}}, lambda kept, jobs: [0.5] * len(jobs), [0.0, 0.1, 0.2], 2)
    assert fake["tau"] == 0.1 and fake["kept"] == {"b": ["p", "q"]}


@pytest.mark.parametrize("noise", ["normal", "truncated"])
@pytest.mark.parametrize("signal", ["normal", "gamma"])
def test_mixture(noise, signal):
    r = np.random.default_rng(3)
    v = np.clip(np.concatenate([[0, 0], r.normal(0.1, 0.02, 40), r.normal(0.7, 0.05, 40)]), 0, 1)
    m = fit_mixture(v, noise=noise, signal=signal)
    assert np.allclose(m.posterior.sum(1), 1) and (m.posterior[:2, 2] == 1).all()
    assert (m.posterior[2:42, 0] > 0.9).all() and (m.posterior[42:, 1] > 0.9).all()
    assert all(b >= a - 1e-9 for a, b in zip(m.trace, m.trace[1:], strict=False))
    edge = fit_mixture([1e-300, 1.0, 0.5, 0.3, 0.2], noise=noise, signal=signal)
    assert np.isfinite(edge.posterior).all()


def test_mixture_edges():
    with pytest.warns(UserWarning):
        assert fit_mixture([0.0, 0.3, 0.3]).degenerate
    with pytest.raises(ValueError):
        fit_mixture([1.2])


def test_special_functions():
    assert stats.t_sf(2.0, 10) == pytest.approx(0.03669402, abs=1e-7) and stats.t_sf(-1.0, 3) == pytest.approx(0.8044989, abs=1e-6)
    assert stats.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert stats.project_simplex([0.2, 0.9, -1]).sum() == pytest.approx(1)
    assert stats.average_ranks([3, 1, 3]).tolist() == [2.5, 1, 2.5]


# tuning, embedding, reports


def test_tuning(spark):
    assert tuning.grid(10, 100, 1, 10)[-1] == 100 and tuning.grid(5, 3) == [] and len(tuning.grid(1, 50, 1, 20)) <= 21
    v = list(range(10, 110, 10))
    assert tuning.elbow(v, [0.1, 0.5, 0.7, 0.8, 0.82, 0.83, 0.835, 0.836, 0.837, 0.838])[1] == "small gain"
    assert tuning.elbow([], []) == (None, "none")
    assert tuning.no_cut(80, 100) and not tuning.no_cut(79, 100)
    w = np.random.default_rng(1).random((12, 12))
    models = coo(spark, w, model="m")
    alphas = spark.createDataFrame([("m", "r", 1.0)], "model string, response string, alpha double")
    got = {r["v"]: r["entropy"] for r in tuning.candidate_entropies(models, alphas, [3, 6], 12).collect()}
    for k in (3, 6):
        p = back(X.prepare(models, k), 12)
        want = -(p[p > 0] * np.log(p[p > 0])).sum() / 12 / np.log(12)
        assert got[k] == pytest.approx(want)


def test_tsne():
    s, label = blocks_similarity([6, 6])
    got = tsne(s, rounds=300, rate=5, seed=1)
    assert got["costs"][-1] <= got["costs"][0] and (got["embedding"] == tsne(s, rounds=300, rate=5, seed=1)["embedding"]).all()
    p, y = probabilities(s), np.random.default_rng(1).normal(size=(12, 2))
    from thicket.functions.tsne import kernel

    def cost(y):
        q = kernel(y)
        off = ~np.eye(12, dtype=bool)
        return (p[off] * np.log(p[off] / (q / q.sum())[off])).sum()

    h = np.zeros_like(y)
    h[3, 1] = 1e-6
    assert gradient(y, p)[3, 1] == pytest.approx((cost(y + h) - cost(y - h)) / 2e-6, rel=1e-4)
    for bad in (np.zeros((3, 3)), np.ones((2, 3)), -s):
        with pytest.raises(ValueError):
            tsne(bad)


def test_reports(spark):
    pairs = spark.createDataFrame([("C1", "A"), ("C1", "A"), ("C1", "B"), ("C2", "B"), ("C2", "C")], "cluster string, annotation string")
    rows = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "cluster string")
    columns = spark.createDataFrame([(c,) for c in "ABCD"], "annotation string")
    got = {(r[0], r[1]): r for r in reports.composition(pairs, rows, columns).collect()}
    assert len(got) == 12 and got["C1", "A"]["of_cluster"] == pytest.approx(2 / 3) and got["C3", "D"]["of_cluster"] == 0
    t = spark.createDataFrame([("g", k, k % 2) for k in range(1, 7)], "group string, time int, event int")
    alive, at_risk = 1.0, 6
    for r in reports.survival(t).orderBy("time").collect():
        alive *= 1 - r["events"] / at_risk
        at_risk -= 1
        assert r["survival"] == pytest.approx(alive)
    x = spark.createDataFrame([(k, k % 2, float(k)) for k in range(1, 13)], "time int, event int, v double")
    for how in ("median", "mean", "maxstat"):
        assert {r[0] for r in reports.split_groups(x, "v", how).select("group").collect()} == {"high", "low"}
    edges = reports.network(coo(spark, np.array([[0, 0.9, 0.2, 0], [0.9, 0, 0.6, 0], [0.2, 0.6, 0, 0.1], [0, 0, 0.1, 0]])), 0.5)
    assert {(r["i"], r["j"]) for r in edges.collect()} == {(0, 1), (1, 2)}


def test_components(spark):
    w = coo(spark, [[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [0, 0, 0, 1]])
    assert {r["i"]: r["component"] for r in X.components(w).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_pipeline(spark):
    long, truth = simulate.simulate_blocks(spark, 60, {"methyl": 8, "gene": 6}, shared_shift=4.0, share_of_features=0.6)
    fit = pipeline.run(spark, long, trees=15, filter_mode="none", run_imd=True, select_rule="threshold", oob=True, model_v=8)
    shared = [r["shared"] for r in truth.where("block = 'gene'").orderBy("sample_idx").collect()]
    assert set(fit.clusters) == {"shared", "gene", "methyl"} and 0 < fit.oob_error < 2
    assert fit.get_data("selected").count() > 0 and fit.tidy_clusters().count() == 180
    assert fit.summary()["samples"] == 60 and len(shared) == 60
    assert {r["block"] for r in fit.shared_fraction.collect()} == {"gene", "methyl"}


def test_merging_joins_siblings_that_agree_less(spark, grown):
    from thicket.operators import merging

    e = leaves.embeddings_of(grown)
    m = merging.merged_membership(grown, e, q=0.0, least=1)
    before = {(r["tree"], r["sample_idx"]): r["leaf"] for r in grown.membership.collect()}
    after = {(r["tree"], r["sample_idx"]): r["leaf"] for r in m.collect()}
    assert set(before) == set(after)
    for t in {k[0] for k in before}:
        pairs = {(before[k], after[k]) for k in before if k[0] == t}
        assert len({b for b, _ in pairs}) == len(pairs)  # whole leaves go together
    alike = merging.merge_tree([1, -1, -1], [2, -1, -1], np.array([1, 1, 2, 2]), {1: 1, 2: 2}, [np.array([[1.0, 2], [1, 2], [5, 1], [5, 1]])], least=1)
    assert alike.tolist() == [2, 2, 2, 2]


def test_subsampled_connections(spark):
    from thicket.plans import reconstruct

    assert reconstruct.plan_of(10, 10) == (True, 1.0, 1.0) and reconstruct.plan_of(600, 10) == (False, 0.2, 1.0)
    r = np.random.default_rng(7)
    x, y = r.normal(size=(40, 30)), r.normal(size=(40, 24))
    parts = reconstruct.fit_connections_subsampled(spark, {"X": (x, None), "Y": (y, None)}, [("Y", "X")], forest.Control(), n_sub=3, trees=3, small=10, least_y=6, least_x=8)[0]
    assert len(parts) == 3 and all(len(p["x_columns"]) == 8 and len(p["y_columns"]) == 6 for p in parts)
    imd = {q["var"]: q["imd"] for q in reconstruct.ensemble_importance(parts).collect()}
    assert set(imd) == {int(c) for p in parts for c in p["x_columns"]} and max(imd.values()) <= 1
    w = forest.average([leaves.forest_weights(p["forest"].membership) for p in parts], ["i", "j"], "w")
    assert all(abs(s - 1) < 1e-9 for _, s in w.groupBy("i").agg(F.sum("w")).collect())


def test_reconstruct_and_cluster(spark):
    from thicket.plans import reconstruct

    s, label = blocks_similarity([6, 6])
    w = coo(spark, s / s.sum(1, keepdims=True), model="A_B").unionByName(coo(spark, s / s.sum(1, keepdims=True), model="B_A"))
    scores = spark.createDataFrame([("A_B", "A", 1.0), ("B_A", "B", 1.0)], "model string, response string, score double")
    for method in ("spectral", "pam", "alternating"):
        got = reconstruct.reconstruct_and_cluster(w, scores, 12, 2, method, None, data=np.eye(12))
        assert same_partition(got["labels"], label)


def test_kinds_and_their_tops():
    from thicket.operators.filtering import tops_by_kind
    from thicket.sources.blocks import kind_of

    names = {"miRNA": "mirna", "micro_rna": "mirna", "dnam": "methylation", "CpG": "methylation", "prot": "protein", "protox": "unknown", "mRNA": "rna", "Expression": "rna", "x": "unknown"}
    assert {n: kind_of(n) for n in names} == names
    assert [filtering.top_of("mirna", 0, n) for n in (149, 150)] == [500, 1000]
    assert [filtering.top_of("methyl", 0, n) for n in (100, 101, 250, 251, 500, 501)] == [5000, 10000, 10000, 15000, 15000, 20000]
    assert filtering.top_of("gene", 0, 10, by_kind={"mRNA": 7.9}) == 7 and filtering.top_of("gene", 0, 10) == 5000
    assert filtering.top_of("mirna", 0, 10, by_kind={"mirna": float("inf")}) == 500
    assert filtering.top_of("b", 1, 10, "manual", manual={"2": 3}) == 3 and filtering.top_of("b", 1, 10, "manual", manual=[4]) == float("inf")
    with pytest.warns(UserWarning):
        assert tops_by_kind({"other": 3, "dnam": 2}) == {"methylation": 2.0}


def test_argument_checks(spark):
    assert checks.seed(-3.0) == -3 and checks.flag(True, "x") is True and checks.choice("a", "ab", "x") == "a"
    for f, bad in ((checks.seed, ("1", 1.5, math.inf, 2**31, True)), (lambda v: checks.flag(v, "x"), (1, None, "yes")), (checks.square, ([], [1, 2], [[1, 2]], [["a"]])), (lambda v: checks.choice(v, ("a",), "x"), ("b",))):
        for v in bad:
            with pytest.raises(ValueError):
                f(v)
    assert checks.square([[1, 2], [3, 4]]).shape == (2, 2)
    assert checks.variable_weights(None, ["a"], "w") is None and checks.variable_weights({"b": 1, "a": 3}, ["a", "b"], "w") == [0.75, 0.25]
    for bad in ([1], [0, 0], [-1, 2], [math.nan, 1], {"a": 1}):
        with pytest.raises(ValueError):
            checks.variable_weights(bad, ["a", "b"], "w")
    assert checks.per_block(None, ["a"]) == {"a": None} and checks.per_block(3, ["a", "b"]) == {"a": 3, "b": 3} and checks.per_block({"b": 2.0}, ["a", "b"]) == {"a": None, "b": 2}
    with pytest.raises(ValueError):
        checks.per_block("2", ["a"])
    assert checks.aligned({"b": 1, "a": 2, "c": 3}, ["a", "b"]) == [2, 1] and checks.aligned([5, 6], ["a", "b"]) == [5, 6]
    with pytest.raises(ValueError):
        checks.aligned([5], ["a", "b"])
    with pytest.raises(ValueError):
        leaves.forest_weights(spark.createDataFrame([(0, 0, 0, 1)], "tree int, sample_idx int, leaf int, inbag int"), "some")
    with pytest.raises(ValueError):
        forest.Control(seed=1.5).check()


def test_giant_share(spark):
    w = coo(spark, [[0, 1, 0, 0, 0], [0, 0, 2, 0, 0], [0, 2, 0, 0, 0], [0, 0, 0, 9, 1], [0, 0, 0, 0, 0]])
    assert X.giant_share(w, 5) == 0.6 and X.giant_share(w, 5, over=1.0) == 0.4 and X.giant_share(w, 5, symmetric=False) == 0.4
    assert X.giant_share(w, 1) == 1.0 and X.giant_share(w.limit(0), 4) == 0.25


def test_reconstruction_error(spark, grown):
    f = grown[0] if isinstance(grown, tuple) else grown
    w = leaves.forest_weights(f.membership)
    long = lambda m, b: spark.createDataFrame([(i, b, f"f{k}", float(v)) for i, row in enumerate(m) for k, v in enumerate(row)], "sample_idx int, block string, feature string, value double")
    dense = back(w, len(f.x))
    side = lambda m: np.mean(((dense @ m - m) ** 2).mean(0) / m.var(0, ddof=1))
    assert leaves.reconstruction_error(w, long(f.x, "x")) == pytest.approx(side(f.x))
    assert leaves.reconstruction_error(w, long(f.x, "x"), long(f.y, "y")) == pytest.approx(side(f.x) + side(f.y))


def test_path_importance_counts_every_passing(spark, grown):
    f = grown[0] if isinstance(grown, tuple) else grown
    n = len(f.x)
    labels = [None if i % 7 == 0 else i % 2 for i in range(n)]
    got = {(r["cluster"], r["side"], r["var"]): r["imd"] for r in importance.path_importance(f, spark.createDataFrame(list(enumerate(labels)), "sample_idx int, cluster int"), unit=False).collect()}
    trees = {}
    for r in f.nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    sums = {}
    for nodes in trees.values():
        for i in range(n):
            at = nodes[0]
            while not at["is_leaf"] and labels[i] is not None:
                for key, s in [((labels[i], "X", at["split_var"]), at["score"]), *(((labels[i], "Y", k), v) for k, v in at["y_stats"].items() if v > 0)]:
                    total = sums.setdefault(key, [0.0, 0])
                    total[0] += s
                    total[1] += 1
                at = nodes[at["left"] if f.x[i, at["split_var"]] <= at["split_val"] else at["right"]]
    assert got.keys() == sums.keys() and all(got[k] == pytest.approx(a / b) for k, (a, b) in sums.items())
    unit = importance.path_importance(f, spark.createDataFrame(list(enumerate(labels)), "sample_idx int, cluster int")).groupBy("cluster", "side").agg(F.sum(F.col("imd") * F.col("imd")).alias("s")).collect()
    assert len(unit) == 4 and all(r["s"] == pytest.approx(1) for r in unit)


def test_choosing_among_tuning_rows():
    assert tuning.fused_most(10) == 10 and tuning.fused_most(10, 0.25) == 3 and tuning.fused_most(3, 9) == 3
    with pytest.raises(ValueError):
        tuning.fused_most(0)
    seen = []
    rows = tuning.until_elbow(list(range(1, 40)), lambda v: seen.append(v) or (min(v, 6)))
    assert [r[0] for r in rows] == seen and 6 < len(rows) < 39
    table = [{"v": v, "k": k, "cost": c, "silhouette": s, "gap": None, "entropy": None} for v, k, c, s in ((5, 2, 3.0, 0.1), (6, 2, 2.0, 0.4), (7, 2, 2.0, 0.2), (5, 3, None, 0.3))]
    assert [(r["v"], r["k"]) for r in tuning.best_rows(table)] == [(6, 2)]
    assert [(r["v"], r["k"]) for r in tuning.best_rows(table, "silhouette")] == [(6, 2), (5, 3)]
    assert tuning.best_rows(table, "elbow") == [table[0]] and tuning.best_rows([*table, {"v": 9, "no_cut": True, "entropy": None}], "elbow")[0]["v"] == 9
    curve = [{"v": v, "k": 2, "entropy": float(min(v, 6))} for v in range(1, 20)]
    assert tuning.best_rows(curve, "elbow")[0]["v"] == tuning.elbow([r["v"] for r in curve], [r["entropy"] for r in curve])[0]
    with pytest.raises(ValueError):
        tuning.best_rows([])
    block = np.kron(np.eye(3), np.ones((5, 5)))
    found = tuning.evaluate(block, 3)
    assert found["k"] == 3 and found["silhouette"] > 0.9 and tuning.evaluate(np.zeros((4, 4)))["gap"] is None
    series = reports.tuning_series(C.spectral(block))
    assert sum(chosen for *_, chosen in series) == 1 and {s for s, *_ in series} == {"eigenvalue difference", "eigenvalue"}
    assert {s for s, *_ in reports.tuning_series(C.pam_tuned(1 - block, range(2, 6)))} >= {"score"}


def test_pipeline_with_k_by_block_and_adaptive_selection(spark):
    long = simulate.simulate_blocks(spark, 60, {"methyl": 8, "gene": 6})[0]
    fit = pipeline.run(spark, long, {"shared": 3, "gene": 2}, trees=8, filter_mode="none", run_imd=True, select_rule="adaptive", adaptive_options={"taus": [0.2, 0.6, 1.0], "repeats": 1})
    assert fit.clusters["shared"]["k"] == 3 and fit.clusters["gene"]["k"] == 2 and set(fit.clusters) == {"shared", "gene", "methyl"}
    got = fit.selected.collect()
    assert len(got) == 14 and 0 < sum(r["selected"] for r in got) and {r["block"] for r in got if r["selected"]} == {"gene", "methyl"}
    assert [r["block"] for r in fit.tidy_shared().collect()] == ["gene", "methyl"]
    assert {r["block"] for r in fit.own_importance().collect()} == {"gene", "methyl"}


def test_levels_by_block(spark):
    assert checks.level("auto", "a") == 0.05 and checks.level(0.2, "a") == 0.2 and checks.level({"b": 0.3, "a": 0.1}, "a") == 0.1 and checks.level({"b": 0.3}, "a") == 0.3
    for bad in (0, 1, "x", None, True, math.nan, {}):
        with pytest.raises(ValueError):
            checks.level(bad, "a")
    post = spark.createDataFrame([(b, f, 1.0, 0.1, 0.9, 0.0) for b in "xy" for f in "pq"], "block string, feature string, imd double, noise double, signal double, zero double")
    got = selection.by_mixture(post, {"x": 0.2, "y": 0.05}).where("selected").collect()
    assert {r["block"] for r in got} == {"x"} and selection.by_mixture(post, "auto").where("selected").count() == 0
    trees = spark.createDataFrame([("x", f, t, v + t / 10) for t in range(3) for f, v in (("p", 1.0), ("q", 0.0))], "block string, feature string, tree int, imd double")
    assert [r["feature"] for r in selection.by_t_test(trees, {"x": 0.05}).where("selected").collect()] == ["p"]


def test_largest_and_discounted_importance(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", math.inf), ("b", math.nan), ("c", None), ("z", 9.0)], "feature string, imd double")
    features = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    assert {r["feature"]: r["imd"] for r in importance.largest_by_feature(rows, features).collect()} == {"a": 3.0, "b": 0.0, "c": 0.0}
    imd = spark.createDataFrame([("x", "a", 4.0), ("x", "b", 2.0), ("x", "c", 0.0)], "block string, feature string, imd double")
    counts = spark.createDataFrame([("x", "a", 1), ("x", "b", 2)], "block string, feature string, times int")
    assert {r["feature"]: r["imd"] for r in importance.discounted(imd, counts, 0.5).collect()} == {"a": 2.0, "b": 2.0, "c": 0.0}
