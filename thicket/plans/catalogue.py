"""All queries of the library on the driver's tables, each with its SQL where SQL can say it.

Inputs: E, the embeddings in long form, dims 0-31 block A and 32-63 block B; M, a leaf membership read off all dims, one tree
each; N, complete binary trees in arithmetic; W, the weights of M."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.functions import cluster as C
from thicket.functions import stats as S
from thicket.functions import tree as kernel
from thicket.operators import filtering, forest, fusion, importance, leaves, merging, metrics, reports, selection, simulate, tuning
from thicket.operators import matrix as X
from thicket.plans import pipeline, reconstruct
from thicket.sources import blocks as B

DIGITS = 8
FINE = 12  # of sums of 1 / (64 * leaf size): at 8 digits a 5 may be the last one, and sums in another order fall to either side
DIMS = 64
QUERIES: dict = {}
SQL: dict[str, str] = {}

E_SQL = "e AS (SELECT vec_id, (d - 1)::INT AS dim, CASE WHEN d <= 32 THEN 'A' ELSE 'B' END AS block, embedding[d]::DOUBLE AS v FROM embeddings, range(1, 65) t(d))"
M_SQL = E_SQL + ", m AS (SELECT dim AS tree, vec_id, floor(100 * v)::INT AS leaf, ((7 * vec_id + 13 * dim) % 3)::INT AS inbag FROM e)"
N_SQL = (
    "n AS (SELECT t::INT AS tree, k::INT AS node, floor(log2(k) + 1e-9)::INT AS depth, ((31 * t + 17 * k) % 10)::INT AS split_var, ((13 * t + 7 * k) % 6)::INT AS msrv FROM range(0, 12) a(t), range(1, 16) b(k))"
)
W_SQL = M_SQL + (
    ", l AS (SELECT tree, leaf, count(*) AS size FROM m GROUP BY ALL)"
    ", w AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(1.0::DOUBLE / size) / 64 AS w FROM m a JOIN m b USING (tree, leaf) JOIN l USING (tree, leaf) GROUP BY ALL)"
)
ADJ_SQL = W_SQL + ", dg AS (SELECT i, w AS d FROM w WHERE i = j), adj AS (SELECT i, j, w / greatest(1 - coalesce(d, 0), 1e-8) AS w FROM w LEFT JOIN dg USING (i) WHERE i <> j)"
TOP_SQL = ADJ_SQL + ", rk AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY round(w, 12) DESC) AS rk FROM adj), tp AS (SELECT i, j, w FROM rk WHERE rk <= 10), p AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM tp)"
#: Two models over the same samples: their trees are the even and the odd dims.
TWO_SQL = M_SQL + (
    ", l AS (SELECT tree, leaf, count(*) AS size FROM m GROUP BY ALL)"
    ", mw AS (SELECT CASE WHEN tree % 2 = 0 THEN 'A_B' ELSE 'B_A' END AS model, a.vec_id AS i, b.vec_id AS j, sum(1.0::DOUBLE / size) / 32 AS w FROM m a JOIN m b USING (tree, leaf) JOIN l USING (tree, leaf) GROUP BY ALL)"
    ", mg AS (SELECT model, i, w AS d FROM mw WHERE i = j), ma AS (SELECT model, i, j, w / greatest(1 - d, 1e-8) AS w FROM mw JOIN mg USING (model, i) WHERE i <> j)"
    ", mr AS (SELECT *, rank() OVER (PARTITION BY model, i ORDER BY round(w, 12) DESC) AS rk FROM ma), mp AS (SELECT model, i, j, w / sum(w) OVER (PARTITION BY model, i) AS w FROM mr WHERE rk <= 10)"
    ", sc(model, response, score) AS (VALUES ('A_B', 'A', 0.9), ('B_A', 'A', 0.1), ('A_B', 'B', 0.25), ('B_A', 'B', 0.75))"
    ", al AS (SELECT model, response, score / sum(score) OVER (PARTITION BY response) AS alpha FROM sc)"
    ", fx AS (SELECT response, i, j, sum(alpha * w) AS w FROM mp JOIN al USING (model) GROUP BY ALL), f AS (SELECT response, i, j, w / sum(w) OVER (PARTITION BY response, i) AS w FROM fx)"
)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to `digits`, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_shares(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The same for values from 0 to 1, by arithmetic, as DuckDB does it: a tenth of the time, which counts for all pairs."""
    at = 10.0**digits
    return df.select(*[(F.floor(F.col(c) * at + 0.5) / at).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = DIGITS, by=rounded):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: by(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = "WITH " + sql
        return f

    return add


def r(expr: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0"


def E(spark: SparkSession, sf: str) -> DataFrame:
    return B.from_arrays(B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding"]), "vec_id", "embedding", {"A": (0, 32), "B": (32, 64)})


def M(spark, sf, dims: int = DIMS) -> DataFrame:
    """A tree for each dim, as in M_SQL."""
    e = B.from_arrays(B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding"]), "vec_id", "embedding", {"A": (0, dims)})
    return e.select(F.col("feature_idx").alias("tree"), "sample_idx", F.floor(100 * F.col("value")).cast("int").alias("leaf"), ((7 * F.col("sample_idx") + 13 * F.col("feature_idx")) % 3).cast("int").alias("inbag"))


def N(spark) -> DataFrame:
    base = spark.range(12 * 15, numPartitions=1).select((F.col("id") / 15).cast("int").alias("tree"), (F.col("id") % 15 + 1).cast("int").alias("node"))
    t, k = F.col("tree"), F.col("node")
    return base.select("tree", "node", F.floor(F.log2("node") + 1e-9).cast("int").alias("depth"), ((31 * t + 17 * k) % 10).alias("split_var"), ((13 * t + 7 * k) % 6).alias("msrv"))


def W(spark, sf, dims: int = DIMS) -> DataFrame:
    return leaves.forest_weights(M(spark, sf, dims))


def W_top(spark, sf, top: int = 10) -> DataFrame:
    """What top_entries(adjust(W), top) reads of W."""
    return leaves.forest_weights(M(spark, sf), top=top)


def two_models(spark, sf, dims: int = DIMS, top: int | None = None) -> DataFrame:
    m = M(spark, sf, dims)
    weights = leaves.forest_weights if top is None else functools.partial(leaves.forest_weights, top=top)
    a, b = (weights(m.where(F.col("tree") % 2 == k)).withColumn("model", F.lit(n)) for k, n in ((0, "A_B"), (1, "B_A")))
    return a.unionByName(b)


def two_scores(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('A_B', 'A', 0.9D), ('B_A', 'A', 0.1D), ('A_B', 'B', 0.25D), ('B_A', 'B', 0.75D) AS t(model, response, score)")


def fused(spark, sf) -> DataFrame:
    return fusion.by_response(X.prepare(two_models(spark, sf, top=10), 10, ["model"]), fusion.shares(two_scores(spark)))


def labels(spark, sf) -> DataFrame:
    return B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id", "label"]).select(F.col("vec_id").alias("sample_idx"), F.col("label").alias("cluster"))


def samples(spark, sf) -> int:
    return B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id"]).count()


# blocks and filters


@query("block_long", E_SQL + f" SELECT block, vec_id AS sample_idx, 'f' || dim AS feature, dim AS feature_idx, {r('v')} AS value FROM e")
def _(spark, sf):
    return E(spark, sf)


STATS_SQL = E_SQL + (
    ", s AS (SELECT block, dim, count(v) AS n, min(v) AS low, max(v) AS high, avg(v) AS mean, var_samp(v) AS variance, median(v) AS med FROM e GROUP BY ALL)"
    ", st AS (SELECT s.*, (SELECT median(abs(e.v - s.med)) FROM e WHERE e.dim = s.dim) AS mad FROM s)"
)


@query("block_stats", STATS_SQL + f" SELECT block, 'f' || dim AS feature, dim AS feature_idx, n, {r('low')} AS low, {r('high')} AS high, {r('mean')} AS mean, {r('variance')} AS variance, {r('mad')} AS mad FROM st")
def _(spark, sf):
    return filtering.feature_stats(E(spark, sf))


for _score, _column in (("mad", "mad"), ("variance", "variance")):
    def _top(spark, sf, score=_score):
        kept = filtering.keep_top(filtering.feature_stats(E(spark, sf)), {"A": 5, "B": 7}, score)
        return kept.select("block", "feature", "rank", F.col("score"))

    query(f"filter_{_score}_topn", STATS_SQL + f", k AS (SELECT block, 'f' || dim AS feature, row_number() OVER (PARTITION BY block ORDER BY {_column} DESC, dim)::INT AS rank, {_column} AS score FROM st WHERE low < high) SELECT block, feature, rank, {r('score')} AS score FROM k WHERE rank <= CASE block WHEN 'A' THEN 5 ELSE 7 END")(_top)


@query("filter_summary", STATS_SQL + " SELECT block, max(n) AS samples, count(*) AS features, count(*) FILTER (WHERE low < high) AS varying, CASE block WHEN 'A' THEN 5 ELSE 7 END::BIGINT AS kept FROM st GROUP BY block")
def _(spark, sf):
    return filtering.filter_blocks(E(spark, sf), {"A": 5, "B": 7})[1]


@query("zero_var_drop", "p AS (SELECT p_partkey, 1.0::DOUBLE AS one, p_size::DOUBLE AS size FROM part) SELECT 'part' AS block, 'p_size' AS feature, count(*) AS n FROM p HAVING min(size) < max(size)")
def _(spark, sf):
    p = B.read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_size"]).withColumn("one", F.lit(1.0))
    return filtering.filter_blocks(B.from_wide(p, "part", "p_partkey", ["one", "p_size"]), {"part": math.inf}, "variance")[0].groupBy("block", "feature").agg(F.count("*").alias("n"))


@query("zscore_block", E_SQL + f" SELECT block, vec_id AS sample_idx, 'f' || dim AS feature, {r('(v - avg(v) OVER (PARTITION BY dim)) / stddev_samp(v) OVER (PARTITION BY dim)')} AS value FROM e")
def _(spark, sf):
    return filtering.zscore(E(spark, sf)).select("block", "sample_idx", "feature", "value")


@query("sample_alignment", "d AS (SELECT 'customers' AS block, c_custkey AS sample_idx, c_custkey AS id FROM customer UNION ALL SELECT 'buyers', o_custkey, o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'late', c_custkey + 1, c_custkey FROM customer WHERE c_custkey % 2 = 0)"
       ", z AS (SELECT block, count(*) AS n FROM d GROUP BY 1), s AS (SELECT a.block AS x, b.block AS y, count(*) AS c, sum((a.sample_idx <> b.sample_idx)::INT) AS mv FROM d a JOIN d b ON a.id = b.id AND a.block < b.block GROUP BY ALL)"
       " SELECT a.block AS block_a, b.block AS block_b, (a.n - coalesce(c, 0))::BIGINT AS only_a, (b.n - coalesce(c, 0))::BIGINT AS only_b, coalesce(mv, 0)::BIGINT AS moved FROM z a JOIN z b ON a.block < b.block LEFT JOIN s ON x = a.block AND y = b.block")
def _(spark, sf):
    c = B.read_table(spark, f"{sf}/customer.parquet", ["c_custkey"])
    o = B.read_table(spark, f"{sf}/orders.parquet", ["o_custkey"]).distinct()
    row = lambda d, n, k, i: d.select(F.lit(n).alias("block"), i.alias("sample_idx"), F.col(k).alias("sample_id"))
    k = F.col("c_custkey")
    return B.alignment(row(c, "customers", "c_custkey", k).unionByName(row(o, "buyers", "o_custkey", F.col("o_custkey"))).unionByName(row(c.where(k % 2 == 0), "late", "c_custkey", k + 1)))


@query("connections_enum", "b AS (SELECT r_name AS block, r_regionkey AS place FROM region) SELECT a.block AS response, c.block AS predictor, (row_number() OVER (ORDER BY a.place, c.place) - 1)::INT AS conn_id FROM b a, b c WHERE a.block <> c.block")
def _(spark, sf):
    b = B.read_table(spark, f"{sf}/region.parquet").select(F.col("r_name").alias("block"), F.col("r_regionkey").alias("place"))
    return B.connections(b).select("response", "predictor", "conn_id")


RANK_SQL = (
    "m AS (SELECT a.n_name || '_' || b.n_name AS model, a.n_name AS response, b.n_name AS predictor, ((a.n_nationkey * 7 + b.n_nationkey * 3) % 11)::DOUBLE AS quality, ((a.n_nationkey * 5 + b.n_nationkey * 2) % 7)::DOUBLE AS nmse FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)"
    ", q AS (SELECT *, rank() OVER (ORDER BY quality DESC) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE + rank() OVER (ORDER BY nmse) + (count(*) OVER (PARTITION BY nmse) - 1) / 2.0::DOUBLE AS rank_sum FROM m)"
    ", c AS (SELECT quantile_cont(rank_sum, 0.8) AS lim, min(rank_sum) AS lo FROM q), k AS (SELECT q.*, rank_sum <= lim OR rank_sum = lo AS kept FROM q, c)"
)


@query("connection_rank_select", RANK_SQL + " SELECT model, response, predictor, round(rank_sum, 8) + 0.0 AS rank_sum, kept, kept AND row_number() OVER (PARTITION BY least(response, predictor), greatest(response, predictor), kept ORDER BY rank_sum, quality DESC, model) = 1 AS selected FROM k")
def _(spark, sf):
    n = B.read_table(spark, f"{sf}/nation.parquet")
    a, b = (n.select(F.col("n_nationkey").alias(f"k{s}"), F.col("n_name").alias(s)) for s in ("response", "predictor"))
    x, y = F.col("kresponse"), F.col("kpredictor")
    m = a.join(b, x != y).select(F.concat_ws("_", "response", "predictor").alias("model"), "response", "predictor", ((x * 7 + y * 3) % 11).cast("double").alias("quality"), ((x * 5 + y * 2) % 7).cast("double").alias("nmse"))
    return fusion.rank_connections(m)


# checks and numbers


@query("sanitize_block", f"x AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer) SELECT 'customer' AS block, c_custkey AS sample_idx, unnest(['c_acctbal', 'c_nationkey']) AS feature, unnest([0, 1]) AS feature_idx, unnest([{r('c_acctbal::DOUBLE')}, c_nationkey::DOUBLE]) AS value FROM x")
def _(spark, sf):
    c = B.read_table(spark, f"{sf}/customer.parquet", ["c_custkey", "c_acctbal", "c_nationkey"])
    return B.from_wide(B.check_block(c, "customer", "c_custkey"), "customer", "c_custkey", ["c_acctbal", "c_nationkey"])


@query("connection_names", "p AS (SELECT a.r_name || '_' || b.r_name AS name, k FROM region a, region b, range(0, 3) t(k) WHERE a.r_name <> b.r_name) SELECT name || CASE WHEN k = 0 THEN '' ELSE '.' || k END AS name FROM p")
def _(spark, sf):
    names = [x[0] for x in B.read_table(spark, f"{sf}/region.parquet").select("r_name").orderBy("r_name").collect()]
    pairs = B.named_connections([*B.ordered_pairs(names), *("_".join(p) for p in B.ordered_pairs(names))], names)
    return spark.createDataFrame([(n,) for n in B.display_names([*pairs, *B.ordered_pairs(names)])], "name string")


@query("variable_weights", f"p AS (SELECT p_partkey, p_size::DOUBLE AS size FROM part) SELECT p_partkey::VARCHAR AS feature, {r('size / (SELECT sum(size) FROM p)')} AS weight FROM p")
def _(spark, sf):
    x = B.read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_size"]).select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_size").cast("double").alias("weight"))
    return filtering.normalised_weights(x.select("feature"), x)


@query("tune_grid", "n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT n, CASE WHEN n - 9 > 20 THEN ceil((n - 10) / 19.0) ELSE 1 END::BIGINT AS step FROM n) SELECT DISTINCT v::INT AS v FROM (SELECT unnest(range(10, n + 1, step)) AS v FROM s UNION ALL SELECT n FROM n)")
def _(spark, sf):
    return spark.createDataFrame([(v,) for v in tuning.grid(10, tuning.fused_most(samples(spark, sf)), 1, 20)], "v int")


@query("spearman_pairs", E_SQL + ", k AS (SELECT vec_id, dim, rank() OVER (PARTITION BY dim ORDER BY v) + (count(*) OVER (PARTITION BY dim, v) - 1) / 2.0::DOUBLE AS k FROM e)"
       f" SELECT a.dim, {r('corr(a.k, b.k)')} AS rho FROM k a JOIN k b ON a.vec_id = b.vec_id AND b.dim = (a.dim + 1) % 64 GROUP BY a.dim")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf, scale=False)
    x = np.hstack([a, b])
    return spark.createDataFrame([(d, S.spearman(x[:, d], x[:, (d + 1) % DIMS])) for d in range(DIMS)], "dim int, rho double")


@query("simplex_rows", E_SQL + (
    ", o AS (SELECT vec_id, v, row_number() OVER w AS k, (sum(v) OVER w - 1) / row_number() OVER w AS t FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY v DESC, dim ROWS UNBOUNDED PRECEDING))"
    ", c AS (SELECT vec_id, max(k) AS k FROM o WHERE v > t GROUP BY 1), th AS (SELECT vec_id, t FROM o JOIN c USING (vec_id, k))"
    f" SELECT vec_id, dim, {r('greatest(v - t, 0)')} AS w FROM e JOIN th USING (vec_id)"
))
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf, scale=False)
    rows = [S.project_simplex(row) for row in np.hstack([a, b])]
    return spark.createDataFrame([(i, d, float(v)) for i, row in enumerate(rows) for d, v in enumerate(row)], "vec_id long, dim int, w double")


@query("density_modes", E_SQL + (
    ", h AS (SELECT dim, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM e GROUP BY dim)"
    ", g AS (SELECT dim, h, (lo - 3 * h) + k * ((hi + 3 * h) - (lo - 3 * h)) / 511 AS x FROM h, range(0, 512) t(k))"
    ", d AS (SELECT dim, x, sum(exp(-0.5 * pow((x - v) / h, 2))) AS d FROM g JOIN e USING (dim) GROUP BY ALL)"
    f" SELECT dim, {r('arg_max(x, d)')} AS mode FROM d GROUP BY dim"
))
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf, scale=False)
    return spark.createDataFrame([(d, S.density_mode(x)) for d, x in enumerate(np.hstack([a, b]).T)], "dim int, mode double")


# trees and leaves


@query("stump_best_split", E_SQL + (
    ", z AS (SELECT vec_id, dim, (v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim) AS z FROM e WHERE dim BETWEEN 32 AND 34)"
    ", x AS (SELECT vec_id, dim AS var, v AS x FROM e WHERE dim < 4), o AS (SELECT var, x, z.dim, sum(z) OVER w AS s, count(*) OVER w AS nl, lead(x) OVER w AS nx, count(*) OVER (PARTITION BY var, z.dim) AS n FROM x JOIN z USING (vec_id) WINDOW w AS (PARTITION BY var, z.dim ORDER BY x, vec_id ROWS UNBOUNDED PRECEDING))"
    ", g AS (SELECT var, x AS cut, avg(s * s / nl + s * s / (n - nl)) AS score FROM o WHERE nx > x GROUP BY var, x)"
    " SELECT var, round(cut, 8) + 0.0 AS cut, round(score, 6) + 0.0 AS score FROM g ORDER BY g.score DESC, var, cut LIMIT 1"
))
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf, scale=False)
    found = kernel.best_split(a[:, :4], b[:, :3], np.arange(len(a)), 4, 3, 0, _InOrder())
    return spark.createDataFrame([(found[0], found[1], round(found[2], 6))], "var int, cut double, score double")


class _InOrder:
    """A stream that draws candidates in their order, so that the kernel tries all of them and the first wins ties."""

    def without_replacement(self, pool, k):
        return list(pool)[:k]


@query("split_stats", E_SQL + (
    ", s AS (SELECT x.dim AS node, y.dim AS response, CASE WHEN x.v <= 0 THEN 'L' ELSE 'R' END AS side, y.v AS y FROM e x JOIN e y USING (vec_id) WHERE x.dim < 4 AND y.dim BETWEEN 32 AND 36)"
    ", a AS (SELECT node, response, count(*) FILTER (WHERE side = 'L') AS nl, count(*) FILTER (WHERE side = 'R') AS nr, avg(y) AS m, stddev_samp(y) AS sd, sum(y) FILTER (WHERE side = 'L') AS sl FROM s GROUP BY ALL)"
    f" SELECT node, response, {r('pow((sl - nl * m) / sd, 2) / nl + pow((sl - nl * m) / sd, 2) / nr')} AS stat FROM a"
))
def _(spark, sf):
    e = E(spark, sf)
    x = e.where("feature_idx < 4").select("sample_idx", F.col("feature_idx").alias("node"), F.when(F.col("value") <= 0, "L").otherwise("R").alias("side"))
    y = e.where("feature_idx BETWEEN 32 AND 36").select("sample_idx", F.col("feature_idx").alias("response"), F.col("value").alias("y"))
    return importance.split_statistics(x.join(y, "sample_idx"))


@query("route_samples", E_SQL + (
    ", p AS (SELECT vec_id, max(v) FILTER (WHERE dim = 0) AS a, max(v) FILTER (WHERE dim = 1) AS b, max(v) FILTER (WHERE dim = 2) AS c FROM e GROUP BY 1)"
    " SELECT 0 AS tree, vec_id AS sample_idx, (CASE WHEN a <= 0 THEN CASE WHEN b <= 0.05 THEN 3 ELSE 4 END ELSE CASE WHEN c <= -0.05 THEN 5 ELSE 6 END END)::INT AS node FROM p"
))
def _(spark, sf):
    nodes = spark.sql("SELECT * FROM VALUES (0, 0, 1, 2, 0, 0.0D, false), (0, 1, 3, 4, 1, 0.05D, false), (0, 2, 5, 6, 2, -0.05D, false) AS t(tree, node, left, right, split_var, split_val, is_leaf)")
    return leaves.route(nodes, E(spark, sf).where("feature_idx < 3"), 2)


@query("fw_all", W_SQL + f" SELECT i, j, {r('w', FINE)} AS w FROM w", FINE, rounded_shares)
def _(spark, sf):
    return W(spark, sf)


def _weights_sql(oob: bool) -> str:
    return M_SQL + (
        ", l AS (SELECT tree, leaf, sum(inbag) AS mass FROM m GROUP BY ALL HAVING sum(inbag) >= 1)"
        f", q AS (SELECT tree, leaf, vec_id AS i, mass FROM m JOIN l USING (tree, leaf){' WHERE inbag = 0' if oob else ''}), c AS (SELECT i, count(*) AS trees FROM q GROUP BY 1)"
        f" SELECT i, m.vec_id AS j, {r('sum(inbag::DOUBLE / mass) / any_value(trees)', FINE)} AS w FROM q JOIN m USING (tree, leaf) JOIN c USING (i) WHERE inbag > 0 GROUP BY ALL"
    )


@query("fw_inbag", _weights_sql(False), FINE)
def _(spark, sf):
    return leaves.forest_weights(M(spark, sf), "inbag")


@query("fw_oob", _weights_sql(True), FINE)
def _(spark, sf):
    return leaves.forest_weights(M(spark, sf), "oob")


OOB_SQL = M_SQL + (
    ", l AS (SELECT tree, leaf, sum(inbag) AS mass FROM m GROUP BY ALL HAVING sum(inbag) >= 1), q AS (SELECT tree, leaf, vec_id AS i, mass FROM m JOIN l USING (tree, leaf) WHERE inbag = 0), c AS (SELECT i, count(*) AS trees FROM q GROUP BY 1)"
    ", ow AS (SELECT i, m.vec_id AS j, sum(inbag::DOUBLE / mass) / any_value(trees) AS w FROM q JOIN m USING (tree, leaf) JOIN c USING (i) WHERE inbag > 0 AND i <> m.vec_id GROUP BY ALL)"
)


@query("oob_wrapper", OOB_SQL + f" SELECT i, j, {r('w', FINE)} AS w FROM ow", FINE)
def _(spark, sf):
    return leaves.oob_weights(M(spark, sf))


@query("oob_sub", M_SQL + (
    ", l AS (SELECT tree, leaf, count(*) AS size FROM m GROUP BY ALL), c AS (SELECT vec_id AS i, count(*) AS trees FROM m WHERE inbag = 0 GROUP BY 1)"
    f" SELECT a.vec_id AS i, b.vec_id AS j, {r('sum(1.0::DOUBLE / size) / any_value(trees)', FINE)} AS w FROM m a JOIN m b USING (tree, leaf) JOIN l USING (tree, leaf) JOIN c ON c.i = a.vec_id WHERE a.inbag = 0 GROUP BY ALL"
), FINE)
def _(spark, sf):
    return leaves.ensemble_oob_weights(M(spark, sf))


@query("prox_all", M_SQL + f" SELECT a.vec_id AS i, b.vec_id AS j, {r('count(*) / 64.0::DOUBLE')} AS w FROM m a JOIN m b USING (tree, leaf) GROUP BY ALL")
def _(spark, sf):
    return leaves.proximity(M(spark, sf))


for _mode, _cond in (("inbag", "> 0"), ("oob", "= 0")):
    query(f"prox_{_mode}", M_SQL + f" SELECT a.vec_id AS i, b.vec_id AS j, {r('avg((a.leaf = b.leaf)::INT::DOUBLE)')} AS w FROM m a JOIN m b USING (tree) WHERE a.inbag {_cond} AND b.inbag {_cond} GROUP BY ALL")(
        lambda spark, sf, mode=_mode: leaves.proximity(M(spark, sf), mode)
    )


@query("enhanced_prox", M_SQL + (
    ", s(tree, leaf_a, leaf_b, corr) AS (SELECT t, -1, 0, (t - 16) / 48.0::DOUBLE FROM range(0, 64) x(t)), g AS (SELECT *, least(1.0, 0.5 * greatest(corr, 0)) AS part FROM s WHERE corr > 0)"
    ", x AS (SELECT a.vec_id AS i, b.vec_id AS j, part FROM g JOIN m a ON a.tree = g.tree AND a.leaf = leaf_a JOIN m b ON b.tree = g.tree AND b.leaf = leaf_b)"
    ", u AS (SELECT a.vec_id AS i, b.vec_id AS j, 1.0::DOUBLE AS part FROM m a JOIN m b USING (tree, leaf) UNION ALL SELECT i, j, part FROM x UNION ALL SELECT j, i, part FROM x)"
    f" SELECT i, j, {r('sum(part) / 64', FINE)} AS w FROM u GROUP BY ALL"
), FINE)
def _(spark, sf):
    s = spark.range(64).select(F.col("id").cast("int").alias("tree"), F.lit(-1).alias("leaf_a"), F.lit(0).alias("leaf_b"), ((F.col("id") - 16) / 48.0).alias("corr"))
    return leaves.enhanced_proximity(M(spark, sf), s)


# matrices


@query("weight_adjust", ADJ_SQL + f" SELECT i, j, {r('w')} AS w FROM adj")
def _(spark, sf):
    return X.adjust(W(spark, sf))


@query("topv_ties", TOP_SQL + f" SELECT i, j, {r('w')} AS w FROM tp")
def _(spark, sf):
    return X.top_entries(X.adjust(W_top(spark, sf)), 10)


@query("topv_strict", ADJ_SQL + f", k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(w, 12) DESC, j) AS k FROM adj) SELECT i, j, {r('w')} AS w FROM k WHERE k <= 10")
def _(spark, sf):
    return X.top_entries(X.adjust(W_top(spark, sf)), 10, ties=False)


@query("row_normalize", ADJ_SQL + f" SELECT i, j, {r('w / sum(w) OVER (PARTITION BY i)')} AS w FROM adj", by=rounded_shares)
def _(spark, sf):
    return leaves.adjusted_weights(M(spark, sf), normalised=True)


@query("prepare_weight", TOP_SQL + f" SELECT i, j, {r('w')} AS w FROM p")
def _(spark, sf):
    return X.prepare(W_top(spark, sf), 10)


@query("row_entropy", TOP_SQL + f" SELECT i, {r('-sum(w * ln(w))')} AS entropy, count(*) AS entries, {r('exp(-sum(w * ln(w)))')} AS n_eff FROM p GROUP BY i")
def _(spark, sf):
    return X.row_entropy(X.prepare(W_top(spark, sf), 10))


@query("neff_topv", ADJ_SQL + ", z AS (SELECT i, w / sum(w) OVER (PARTITION BY i) AS p FROM adj), h AS (SELECT exp(-sum(p * ln(p))) AS n FROM z GROUP BY i) SELECT least((SELECT count(*) FROM embeddings), greatest(10, ceil(quantile_cont(n, 0.5))))::BIGINT AS v FROM h")
def _(spark, sf):
    return spark.createDataFrame([(X.effective_top(X.adjust(W(spark, sf)), samples(spark, sf)),)], "v long")


@query("fused_entropy", TOP_SQL + f", h AS (SELECT -sum(w * ln(w)) AS h FROM p GROUP BY i) SELECT {r('sum(h) / any_value(n * ln(n))')} AS entropy FROM h, (SELECT count(*)::DOUBLE AS n FROM embeddings)")
def _(spark, sf):
    return X.mean_entropy(X.prepare(W_top(spark, sf), 10), samples(spark, sf))


@query("weight_concentration", TOP_SQL + f", h AS (SELECT -sum(w * ln(w)) AS h, count(*) AS k FROM p GROUP BY i) SELECT {r('1 - avg(h / ln(k))')} AS concentration FROM h")
def _(spark, sf):
    return X.concentration(X.prepare(W_top(spark, sf), 10))


GRAPH_SQL = "RECURSIVE u AS (SELECT n_nationkey::BIGINT AS i, (n_nationkey % 7)::BIGINT AS j FROM nation), v AS (SELECT i, j FROM u WHERE i <> j AND (i + j) % 4 > 0 UNION SELECT j, i FROM u WHERE i <> j AND (i + j) % 4 > 0), a AS (SELECT i FROM u UNION SELECT j FROM u), c AS (SELECT i, i AS c FROM a UNION SELECT v.j, c.c FROM c JOIN v ON v.i = c.i), m AS (SELECT i, min(c) AS component FROM c GROUP BY i)"


def _graph(spark, sf) -> DataFrame:
    """An edge from each nation's key to its remainder by 7, of weight (i + j) mod 4: some of 0, below every threshold."""
    k = F.col("n_nationkey").cast("long")
    return B.read_table(spark, f"{sf}/nation.parquet", ["n_nationkey"]).select(k.alias("i"), (k % 7).alias("j"), ((k + k % 7) % 4).cast("double").alias("w"))


@query("components", GRAPH_SQL + " SELECT i, component FROM m")
def _(spark, sf):
    return X.components(_graph(spark, sf))


@query("gcc_ratio", GRAPH_SQL + f", z AS (SELECT component, count(*) AS n FROM m GROUP BY 1) SELECT {r('max(n) / (SELECT count(*) FROM nation)::DOUBLE')} AS ratio FROM z")
def _(spark, sf):
    return spark.createDataFrame([(X.giant_share(_graph(spark, sf), B.read_table(spark, f"{sf}/nation.parquet").count()),)], "ratio double")


@query("sim_second", TOP_SQL + f" SELECT a.i, b.i AS j, {r('sum(a.w * b.w)')} AS w FROM p a JOIN p b USING (j) WHERE a.i <> b.i GROUP BY ALL")
def _(spark, sf):
    return X.second_order(X.prepare(W_top(spark, sf), 10))


@query("sim_first", TOP_SQL + f" SELECT i, j, {r('sum(w) / 2')} AS w FROM (SELECT i, j, w FROM p UNION ALL SELECT j, i, w FROM p) GROUP BY ALL")
def _(spark, sf):
    return X.first_order(X.prepare(W_top(spark, sf), 10))


S_SQL = TOP_SQL + ", s AS (SELECT a.i, b.i AS j, sum(a.w * b.w) AS w FROM p a JOIN p b USING (j) WHERE a.i <> b.i GROUP BY ALL)"
KNN_SQL = S_SQL + ", kr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(w, 12) DESC, j) AS k FROM s), kn AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM kr WHERE k <= 5 UNION ALL SELECT j, i, w FROM kr WHERE k <= 5) GROUP BY ALL)"


@query("knn_sparsify", KNN_SQL + f" SELECT i, j, {r('w')} AS w FROM kn")
def _(spark, sf):
    return X.nearest(X.second_order(X.prepare(W_top(spark, sf), 10)), 5)


@query("laplacian", KNN_SQL + f" SELECT i, j, {r('-w')} AS w FROM kn UNION ALL SELECT i, i, {r('sum(w)')} FROM kn GROUP BY i")
def _(spark, sf):
    return X.laplacian(X.nearest(X.second_order(X.prepare(W_top(spark, sf), 10)), 5))


@query("modularity_score", KNN_SQL + ", c AS (SELECT vec_id AS i, label AS c FROM embeddings), a AS (SELECT x.c AS ci, sum(w) AS d, sum(CASE WHEN x.c = y.c THEN w ELSE 0 END) AS ins FROM kn JOIN c x ON x.i = kn.i JOIN c y ON y.i = kn.j GROUP BY 1)"
       f" SELECT {r('sum(ins) / sum(d) - sum(d * d) / (sum(d) * sum(d))')} AS modularity FROM a")
def _(spark, sf):
    return X.modularity(X.nearest(X.second_order(X.prepare(W_top(spark, sf), 10)), 5), labels(spark, sf).withColumnRenamed("sample_idx", "i"))


@query("silhouette_avg", E_SQL + (
    ", d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM e a JOIN e b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.dim < 6 GROUP BY ALL), l AS (SELECT vec_id, label FROM embeddings)"
    ", s AS (SELECT i, x.label AS ci, y.label AS cj, avg(d) AS m FROM d JOIN l x ON x.vec_id = i JOIN l y ON y.vec_id = j GROUP BY ALL), t AS (SELECT i, max(m) FILTER (WHERE ci = cj) AS a, min(m) FILTER (WHERE ci <> cj) AS b FROM s GROUP BY i)"
    f" SELECT {r('avg((b - a) / greatest(a, b))')} AS silhouette FROM t"
))
def _(spark, sf):
    e = E(spark, sf).where("feature_idx < 6")
    a, b = (e.select(F.col("sample_idx").alias(k), "feature_idx", F.col("value").alias(f"v{k}")) for k in "ij")
    d = a.join(b, "feature_idx").where("i <> j").groupBy("i", "j").agg(F.sqrt(F.sum((F.col("vi") - F.col("vj")) * (F.col("vi") - F.col("vj")))).alias("d"))
    return metrics.mean_silhouette(metrics.silhouette(d, labels(spark, sf)))


# fusion


@query("fuse_response", TWO_SQL + f" SELECT response, i, j, {r('w')} AS w FROM f")
def _(spark, sf):
    return fused(spark, sf)


@query("fuse_global_avg", TWO_SQL + f" SELECT i, j, {r('sum(w) / 2')} AS w FROM f GROUP BY ALL")
def _(spark, sf):
    return fusion.overall(fused(spark, sf), k=2)


@query("fuse_global_pmin", TWO_SQL + f", g AS (SELECT i, j, min(w) AS w FROM f GROUP BY ALL HAVING count(*) = 2) SELECT i, j, {r('w / sum(w) OVER (PARTITION BY i)')} AS w FROM g")
def _(spark, sf):
    return fusion.overall(fused(spark, sf), "pmin", k=2)


RES_SQL = TWO_SQL + ", sh AS (SELECT f.response AS block, f.i AS vec_id, e.dim, sum(f.w * e.v) AS s FROM f JOIN e ON e.block = f.response AND e.vec_id = f.j GROUP BY ALL), rs AS (SELECT block, vec_id, dim, e.v, e.v - coalesce(s, 0) AS rv FROM e LEFT JOIN sh USING (block, vec_id, dim))"


@query("recon_matmul", TOP_SQL + f" SELECT e.block, p.i AS sample_idx, 'f' || e.dim AS feature, {r('sum(p.w * e.v)')} AS value FROM p JOIN e ON e.vec_id = p.j GROUP BY ALL")
def _(spark, sf):
    return X.times_block(X.prepare(W_top(spark, sf), 10), E(spark, sf))


@query("residual", RES_SQL + f" SELECT block, vec_id AS sample_idx, 'f' || dim AS feature, {r('rv')} AS value FROM rs")
def _(spark, sf):
    return fusion.residual(E(spark, sf), fused(spark, sf)).select("block", "sample_idx", "feature", "value")


@query("shared_frac", RES_SQL + f" SELECT block, {r('1 - sum(rv * rv) / sum(v * v)')} AS shared_frac FROM rs GROUP BY block")
def _(spark, sf):
    x = E(spark, sf)
    return fusion.shared_fraction(x, fusion.residual(x, fused(spark, sf)))


@query("oob_nmse", OOB_SQL + (
    ", pr AS (SELECT i, dim, sum(w * v) AS p FROM ow JOIN e ON e.vec_id = j GROUP BY ALL), er AS (SELECT dim, avg(pow(p - v, 2)) AS er FROM pr JOIN e ON e.vec_id = i AND e.dim = pr.dim GROUP BY pr.dim AS dim)"
    ", vr AS (SELECT dim, greatest(var_samp(v), 1e-12) AS vr FROM e GROUP BY dim)"
    f" SELECT {r('avg(er / vr)')} AS nmse FROM er JOIN vr USING (dim)"
).replace("SELECT dim, avg(pow(p - v, 2)) AS er FROM pr JOIN e ON e.vec_id = i AND e.dim = pr.dim GROUP BY pr.dim AS dim", "SELECT pr.dim, avg(pow(p - v, 2)) AS er FROM pr JOIN e ON e.vec_id = i AND e.dim = pr.dim GROUP BY pr.dim"))
def _(spark, sf):
    return leaves.forest_nmse(M(spark, sf), E(spark, sf), "oob")


@query("r_squared_error", W_SQL + (
    ", pr AS (SELECT i, dim, sum(w * v) AS p FROM w JOIN e ON e.vec_id = j GROUP BY ALL), er AS (SELECT pr.dim, e.block, avg(pow(p - v, 2)) AS er FROM pr JOIN e ON e.vec_id = i AND e.dim = pr.dim GROUP BY pr.dim, e.block)"
    ", vr AS (SELECT dim, greatest(var_samp(v), 1e-12) AS vr FROM e GROUP BY dim), bl AS (SELECT block, avg(er / vr) AS e FROM er JOIN vr USING (dim) GROUP BY block)"
    f" SELECT {r('sum(e)')} AS error FROM bl"
))
def _(spark, sf):
    m, e = M(spark, sf), E(spark, sf)
    return spark.createDataFrame([(sum(leaves.forest_nmse(m, e.where(F.col("block") == b)).first()[0] for b in "AB"),)], "error double")


@query("elbow_table", (
    "c AS (SELECT r_regionkey AS v, ln(2 + r_regionkey::DOUBLE) AS entropy FROM region), d AS (SELECT *, entropy - lag(entropy) OVER (ORDER BY v) AS delta FROM c)"
    f" SELECT v, {r('entropy')} AS entropy, {r('delta')} AS delta, {r('CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END')} AS gain, {r('CASE WHEN delta IS NOT NULL THEN avg(greatest(delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (ORDER BY v ROWS 2 PRECEDING) END')} AS smooth FROM d"
))
def _(spark, sf):
    return tuning.elbow_table(B.read_table(spark, f"{sf}/region.parquet").select(F.col("r_regionkey").alias("v"), F.ln(2 + F.col("r_regionkey").cast("double")).alias("entropy")))


@query("candidate_entropies", TWO_SQL.replace(", mp AS", ", cv(v) AS (VALUES (5), (10), (20)), mp AS").replace("(SELECT model, i, j, w / sum(w) OVER (PARTITION BY model, i) AS w FROM mr WHERE rk <= 10)", "(SELECT v, model, i, j, w / sum(w) OVER (PARTITION BY v, model, i) AS w FROM mr JOIN cv ON rk <= v)")
       .replace("fx AS (SELECT response, i,", "fx AS (SELECT v, response, i,").replace("f AS (SELECT response, i, j, w / sum(w) OVER (PARTITION BY response, i)", "f AS (SELECT v, response, i, j, w / sum(w) OVER (PARTITION BY v, response, i)")
       + f", g AS (SELECT v, i, j, sum(w) / 2 AS w FROM f GROUP BY ALL), gn AS (SELECT v, i, w / sum(w) OVER (PARTITION BY v, i) AS p FROM g), h AS (SELECT v, i, -sum(p * ln(p)) AS h FROM gn GROUP BY ALL) SELECT v, {r('sum(h) / any_value(n * ln(n))')} AS entropy FROM h, (SELECT count(*)::DOUBLE AS n FROM embeddings) GROUP BY v")
def _(spark, sf):
    return tuning.candidate_entropies(two_models(spark, sf, top=20), fusion.shares(two_scores(spark)), [5, 10, 20], samples(spark, sf))


# importance and selection


T_SQL = N_SQL + ", d AS (SELECT tree, split_var AS var, 1.0::DOUBLE / (min(depth) + 1) AS imd FROM n GROUP BY ALL), v AS (SELECT k::INT AS var FROM range(0, 10) x(k)), fm AS (SELECT var, coalesce(sum(imd), 0) / 12 AS imd FROM v LEFT JOIN d USING (var) GROUP BY var)"


def _vars(spark, n=10):
    return spark.range(n, numPartitions=1).select(F.col("id").cast("int").alias("var"))


def _imd(spark) -> DataFrame:
    """(block, feature, imd): x-side and y-side means of N."""
    x = importance.forest_mean(importance.per_tree(N(spark)), 12, _vars(spark)).select(F.lit("X").alias("block"), F.concat(F.lit("v"), "var").alias("feature"), "imd")
    y = importance.forest_mean(importance.per_tree(N(spark), "msrv"), 12, _vars(spark, 6)).select(F.lit("Y").alias("block"), F.concat(F.lit("v"), "var").alias("feature"), "imd")
    return x.unionByName(y)


I_SQL = T_SQL + (
    ", yd AS (SELECT tree, msrv AS var, 1.0::DOUBLE / (min(depth) + 1) AS imd FROM n GROUP BY ALL), ym AS (SELECT var, coalesce(sum(imd), 0) / 12 AS imd FROM v LEFT JOIN yd USING (var) WHERE var < 6 GROUP BY var)"
    ", im AS (SELECT 'X' AS block, 'v' || var AS feature, imd FROM fm UNION ALL SELECT 'Y', 'v' || var, imd FROM ym)"
)


@query("imd_per_tree", T_SQL + f" SELECT tree, var, {r('imd')} AS imd FROM d")
def _(spark, sf):
    return importance.per_tree(N(spark))


@query("imd_forest", T_SQL + f" SELECT var, {r('imd')} AS imd FROM fm")
def _(spark, sf):
    return importance.forest_mean(importance.per_tree(N(spark)), 12, _vars(spark))


@query("imd_used_mean", T_SQL + f" SELECT var, {r('avg(imd)')} AS imd FROM d GROUP BY var")
def _(spark, sf):
    return importance.used_mean(importance.per_tree(N(spark)))


@query("imd_usage", T_SQL + f" SELECT var, {r('count(*) / 12.0::DOUBLE')} AS share FROM d GROUP BY var")
def _(spark, sf):
    return importance.usage(importance.per_tree(N(spark)), 12)


@query("imd_block_mean", I_SQL + f", b AS (SELECT feature, avg(imd) AS imd FROM (SELECT * FROM im WHERE feature < 'v6') GROUP BY feature) SELECT 'X' AS block, feature, {r('imd / sqrt(sum(imd * imd) OVER ())')} AS imd FROM b")
def _(spark, sf):
    models = _imd(spark).where("feature < 'v6'").select(F.concat(F.lit("m"), "block").alias("model"), F.lit("X").alias("block"), "feature", "imd")
    return importance.block_mean(models, unit=True)


PAIR_SQL = N_SQL + ", pw AS (SELECT split_var AS var, msrv, sum(1.0::DOUBLE / (depth + 1)) / 12 AS w FROM n GROUP BY ALL)"


@query("pairwise_adj", PAIR_SQL + f" SELECT var, msrv, {r('w')} AS w FROM pw")
def _(spark, sf):
    return importance.pairwise(N(spark), 12)


@query("pairwise_norm", PAIR_SQL + (
    ", o AS (SELECT 'X' AS block1, 'v' || var AS f1, 'Y' AS block2, 'v' || msrv AS f2, w FROM pw), u AS (SELECT * FROM o UNION ALL SELECT block2, f2, block1, f1, w FROM o), s AS (SELECT block1, f1, block2, f2, sum(w) AS w FROM u GROUP BY ALL)"
    f", dd AS (SELECT block1, f1, sum(w) AS d FROM s GROUP BY ALL) SELECT s.block1, s.f1, s.block2, s.f2, {r('w / sqrt(a.d * b.d)')} AS w FROM s JOIN dd a ON a.block1 = s.block1 AND a.f1 = s.f1 JOIN dd b ON b.block1 = s.block2 AND b.f1 = s.f2"
))
def _(spark, sf):
    p = importance.pairwise(N(spark), 12).select(F.lit("m").alias("model"), F.lit("X").alias("block1"), F.concat(F.lit("v"), "var").alias("f1"), F.lit("Y").alias("block2"), F.concat(F.lit("v"), "msrv").alias("f2"), "w")
    return importance.adjacency(p, scaled=True)


@query("vs_thres", I_SQL + f" SELECT block, feature, {r('imd')} AS imd, imd > 0.5 * stddev_samp(imd) OVER (PARTITION BY block) AS selected FROM im")
def _(spark, sf):
    return selection.by_threshold(_imd(spark), 0.5)


TS_SQL = T_SQL + (
    ", g AS (SELECT v.var, t.t AS tree, coalesce(imd, 0) AS imd FROM v CROSS JOIN range(0, 12) t(t) LEFT JOIN d ON d.var = v.var AND d.tree = t.t), a AS (SELECT var, avg(imd) AS m, stddev_samp(imd) AS s, count(*) AS n, sum(imd) AS tot FROM g GROUP BY var)"
    ", ts AS (SELECT 'X' AS block, 'v' || var AS feature, CASE WHEN s > 0 THEN (m - sum(tot) OVER () / sum(n) OVER ()) / (s / sqrt(n)) END AS t, (n - 1)::BIGINT AS df FROM a)"
)


def _trees(spark) -> DataFrame:
    every = _vars(spark).crossJoin(spark.range(12, numPartitions=1).select(F.col("id").cast("int").alias("tree")))
    return every.join(importance.per_tree(N(spark)), ["tree", "var"], "left").fillna(0.0, ["imd"]).select(F.lit("X").alias("block"), F.concat(F.lit("v"), "var").alias("feature"), "tree", "imd")


@query("vs_tscore", TS_SQL + f" SELECT block, feature, {r('t')} AS t, df FROM ts")
def _(spark, sf):
    return selection.t_statistics(_trees(spark)).select("block", "feature", "t", "df")


MAJ_SQL = N_SQL + ", kv AS (SELECT 't' || (tree % 3) AS model, 'X' AS block, 'v' || split_var AS feature, min(depth) <= 1 AS keep FROM n GROUP BY ALL)"


@query("vs_majority", MAJ_SQL + ", g AS (SELECT feature, avg(keep::INT) > 0.5 AS s FROM kv GROUP BY 1) SELECT 'X' AS block, 'v' || k AS feature, coalesce(s, true) AS selected FROM range(0, 12) x(k) LEFT JOIN g ON g.feature = 'v' || k")
def _(spark, sf):
    votes = N(spark).groupBy(F.concat(F.lit("t"), F.col("tree") % 3).alias("model"), F.lit("X").alias("block"), F.concat(F.lit("v"), "split_var").alias("feature")).agg((F.min("depth") <= 1).alias("keep"))
    return selection.majority(votes, _vars(spark, 12).select(F.lit("X").alias("block"), F.concat(F.lit("v"), "var").alias("feature")))


@query("vs_fdr_auto", I_SQL + ", c AS (SELECT block, feature, imd, greatest(0, 1 - 2 * imd) / 4 AS chance FROM im), f AS (SELECT *, avg(chance) OVER (PARTITION BY block ORDER BY round(chance, 12), feature ROWS UNBOUNDED PRECEDING) AS fdr FROM c)"
       f" SELECT block, feature, {r('fdr')} AS fdr, imd > 0 AND fdr <= 0.05 AS selected FROM f")
def _(spark, sf):
    post = _imd(spark).withColumn("noise", F.greatest(F.lit(0.0), 1 - 2 * F.col("imd")) / 4).withColumn("zero", F.lit(0.0))
    return selection.by_mixture(post, None).select("block", "feature", "fdr", "selected")


@query("vs_union", I_SQL + ", th AS (SELECT block, feature, imd > 1.5 * stddev_samp(imd) OVER (PARTITION BY block) AS s FROM im) SELECT block, feature FROM th WHERE s UNION SELECT block, feature FROM im WHERE imd > 0.4")
def _(spark, sf):
    i = _imd(spark)
    return selection.union_of(selection.by_threshold(i, 1.5), i.withColumn("selected", F.col("imd") > 0.4))


@query("vs_summary", I_SQL + f", th AS (SELECT block, imd > 2.0 * stddev_samp(imd) OVER (PARTITION BY block) AS s FROM im) SELECT block, count(*) AS p_total, count(*) FILTER (WHERE s) AS p_selected, {r('count(*) FILTER (WHERE s) / count(*)::DOUBLE')} AS ratio FROM th GROUP BY block")
def _(spark, sf):
    return selection.summary(selection.by_threshold(_imd(spark), 2.0))


# labels


C_SQL = "l AS (SELECT c_mktsegment AS pred, c_nationkey AS ref FROM customer), c AS (SELECT pred, ref, count(*) AS n FROM l GROUP BY ALL), z AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS a, sum(n) OVER (PARTITION BY ref) AS b, sum(n) OVER () AS t FROM c)"


def _pairs(spark, sf):
    return B.read_table(spark, f"{sf}/customer.parquet", ["c_mktsegment", "c_nationkey"]).select(F.col("c_mktsegment").alias("pred"), F.col("c_nationkey").alias("ref"))


@query("cluster_contingency", C_SQL + " SELECT pred, ref, n, a::BIGINT AS n_pred, b::BIGINT AS n_ref, t::BIGINT AS total FROM z")
def _(spark, sf):
    return metrics.contingency(_pairs(spark, sf))


AGREE_SQL = C_SQL + (
    ", q AS (SELECT max(t) AS t, sum(n * (n - 1) / 2.0) AS both_, sum(p * ln(n * t / (a * b))) AS mi FROM (SELECT *, n / t::DOUBLE AS p FROM z))"
    ", x AS (SELECT sum(a * (a - 1) / 2.0) AS x, -sum(a / t::DOUBLE * ln(a / t::DOUBLE)) AS hx FROM (SELECT DISTINCT pred, a, t FROM z)), y AS (SELECT sum(b * (b - 1) / 2.0) AS y, -sum(b / t::DOUBLE * ln(b / t::DOUBLE)) AS hy FROM (SELECT DISTINCT ref, b, t FROM z))"
    ", h AS (SELECT sum(k) AS hits FROM (SELECT max(n) AS k FROM z GROUP BY pred)), ag AS (SELECT t::BIGINT AS n, both_, x, y, mi, hx, hy, hits, x * y / (t * (t - 1) / 2.0) AS ex FROM q, x, y, h)"
)
for _name, _expr in (("ari", "(both_ - ex) / ((x + y) / 2 - ex)"), ("jaccard", "both_ / (x + y - both_)"), ("nmi", "mi / sqrt(hx * hy)"), ("purity", "hits / n::DOUBLE")):
    query(f"cluster_{_name}", AGREE_SQL + f" SELECT n, {r(_expr)} AS {_name} FROM ag")(lambda spark, sf, c=_name: metrics.agreement(_pairs(spark, sf)).select("n", c))


@query("metric_matrix", (
    "l AS (SELECT doc_id, 'quality' AS name, quality AS k FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels UNION ALL SELECT doc_id, 'third', doc_id % 3 FROM labels)"
    ", c AS (SELECT a.name AS na, b.name AS nb, a.k AS p, b.k AS q, count(*) AS n FROM l a JOIN l b USING (doc_id) WHERE a.name <> b.name GROUP BY ALL)"
    ", s AS (SELECT na, nb, sum(n) AS t, sum(n * (n - 1) / 2.0) AS b FROM c GROUP BY ALL), x AS (SELECT na, nb, sum(a * (a - 1) / 2.0) AS x FROM (SELECT na, nb, p, sum(n) AS a FROM c GROUP BY ALL) GROUP BY ALL), y AS (SELECT na, nb, sum(a * (a - 1) / 2.0) AS y FROM (SELECT na, nb, q, sum(n) AS a FROM c GROUP BY ALL) GROUP BY ALL)"
    f" SELECT na AS name_a, nb AS name_b, {r('(b - x * y / (t * (t - 1) / 2.0)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2.0))')} AS value FROM s JOIN x USING (na, nb) JOIN y USING (na, nb) UNION ALL SELECT DISTINCT name, name, 1.0 FROM l"
))
def _(spark, sf):
    d = B.read_table(spark, f"{sf}/labels.parquet")
    one = lambda n, c: d.select(F.lit(n).alias("name"), F.col("doc_id").alias("sample_idx"), c.cast("long").alias("cluster"))
    return metrics.metric_matrix(one("quality", F.col("quality")).unionByName(one("toxic", F.col("toxic"))).unionByName(one("third", F.col("doc_id") % 3)))


@query("coassign", "l AS (SELECT r::INT AS rep, vec_id, (vec_id * (r + 3) + label) % 4 AS k FROM embeddings, range(0, 4) x(r) WHERE (vec_id + r) % 5 > 0)"
       f" SELECT a.vec_id AS i, b.vec_id AS j, {r('avg((a.k = b.k)::INT::DOUBLE)')} AS share FROM l a JOIN l b USING (rep) GROUP BY ALL")
def _(spark, sf):
    l = labels(spark, sf).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("rep"))).where("(sample_idx + rep) % 5 > 0")  # noqa: E741
    return metrics.co_assignment(l.select("rep", "sample_idx", ((F.col("sample_idx") * (F.col("rep") + 3) + F.col("cluster")) % 4).alias("cluster")))


CP_SQL = W_SQL + ", v AS (SELECT w.i, label AS class, sum(w) AS p FROM w JOIN embeddings ON vec_id = j GROUP BY ALL), cp AS (SELECT i, class, p / sum(p) OVER (PARTITION BY i) AS prob FROM v)"


def _probs(spark, sf):
    return leaves_probs(W(spark, sf), labels(spark, sf))


def leaves_probs(w, l):  # noqa: E741
    return forest.class_probabilities(w, l.withColumnRenamed("cluster", "class"))


@query("class_prob", CP_SQL + f" SELECT i, class, {r('prob')} AS prob FROM cp")
def _(spark, sf):
    return _probs(spark, sf)


@query("class_pred", CP_SQL + f", k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(prob, 12) DESC, class) AS k FROM cp) SELECT i, class AS predicted, {r('prob')} AS prob FROM k WHERE k = 1")
def _(spark, sf):
    return forest.class_predictions(_probs(spark, sf))


# reports


@query("composition", (
    "p AS (SELECT c_mktsegment AS cluster, c_nationkey AS annotation FROM customer), x AS (SELECT DISTINCT cluster FROM p), y AS (SELECT DISTINCT annotation FROM p), k AS (SELECT cluster, annotation, count(*) AS n FROM p GROUP BY ALL)"
    ", z AS (SELECT cluster, annotation, coalesce(n, 0) AS n FROM x CROSS JOIN y LEFT JOIN k USING (cluster, annotation))"
    f" SELECT cluster, annotation, n, {r('n / (sum(n) OVER (PARTITION BY cluster))::DOUBLE')} AS of_cluster, {r('n / (sum(n) OVER (PARTITION BY annotation))::DOUBLE')} AS of_annotation, {r('n / (sum(n) OVER ())::DOUBLE')} AS of_total FROM z"
))
def _(spark, sf):
    return reports.composition(_pairs(spark, sf).select(F.col("pred").alias("cluster"), F.col("ref").alias("annotation")))


KM_SQL = "k AS (SELECT event_type AS grp, user_id % 40 AS time, (event_id % 2)::INT AS event FROM events), t AS (SELECT grp, time, sum(event) AS d, count(*) AS c FROM k GROUP BY ALL), q AS (SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rk FROM t)"


def _km(spark, sf):
    return B.read_table(spark, f"{sf}/events.parquet", ["event_id", "user_id", "event_type"]).select(F.col("event_type").alias("group"), (F.col("user_id") % 40).alias("time"), (F.col("event_id") % 2).cast("int").alias("event"))


@query("km_curve", KM_SQL + f" SELECT grp AS \"group\", time, rk::BIGINT AS at_risk, d::BIGINT AS events, {r('CASE WHEN bool_or(d = rk) OVER w THEN 0 ELSE exp(sum(CASE WHEN d < rk THEN ln(1 - d / rk::DOUBLE) ELSE 0 END) OVER w) END')} AS survival FROM q WINDOW w AS (PARTITION BY grp ORDER BY time ROWS UNBOUNDED PRECEDING)")
def _(spark, sf):
    return reports.survival(_km(spark, sf))


@query("log_rank", "k AS (SELECT CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS grp, user_id % 40 AS time, (event_id % 2)::INT AS event FROM events), t AS (SELECT time, sum(event) AS d, count(*) AS c, coalesce(sum(event) FILTER (WHERE grp = 'a'), 0) AS d1, count(*) FILTER (WHERE grp = 'a') AS c1 FROM k GROUP BY ALL)"
       ", q AS (SELECT *, sum(c) OVER w AS rk, sum(c1) OVER w AS r1 FROM t WINDOW w AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), v AS (SELECT d, d1, d * r1 / rk::DOUBLE AS ex, CASE WHEN rk > 1 THEN d * (r1 / rk::DOUBLE) * (1 - r1 / rk::DOUBLE) * (rk - d) / (rk - 1)::DOUBLE ELSE 0 END AS va FROM q WHERE d > 0)"
       f" SELECT sum(d1)::BIGINT AS observed, {r('sum(ex)')} AS expected, {r('sum(va)')} AS variance, {r('pow(sum(d1) - sum(ex), 2) / sum(va)')} AS chi2 FROM v")
def _(spark, sf):
    e = B.read_table(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"])
    return reports.log_rank(e.select(F.when(F.col("value") > 50, "a").otherwise("b").alias("group"), (F.col("user_id") % 40).alias("time"), (F.col("event_id") % 2).cast("int").alias("event")))


@query("top_vars", I_SQL + f", k AS (SELECT block, feature, imd, row_number() OVER (PARTITION BY block ORDER BY round(imd, 12) DESC, feature)::INT AS rank FROM im WHERE imd > 0) SELECT block, feature, {r('imd')} AS imd, rank FROM k WHERE rank <= 4")
def _(spark, sf):
    return reports.top_features(_imd(spark), 4)


@query("tidy_imd", I_SQL + f" SELECT 'imd' AS source, block, feature AS variable, {r('imd')} AS weight, {r('abs(imd)')} AS abs_weight, row_number() OVER (PARTITION BY block ORDER BY round(abs(imd), 12) DESC, feature)::INT AS rank FROM im")
def _(spark, sf):
    return reports.tidy_importance(_imd(spark))


@query("network_edges", KNN_SQL + f", q AS (SELECT quantile_cont(w, 0.75) AS c FROM kn WHERE i < j AND w > 0) SELECT i, j, {r('w')} AS w FROM kn, q WHERE i < j AND round(w, 12) > round(c, 12)")
def _(spark, sf):
    return reports.network(X.nearest(X.second_order(X.prepare(W_top(spark, sf), 10)), 5))


@query("chord_pairs", KNN_SQL + f" SELECT i, j, {r('w')} AS w, a.label AS group_i, b.label AS group_j FROM kn JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j WHERE i < j AND w > 0.01")
def _(spark, sf):
    groups = labels(spark, sf).select(F.col("sample_idx").alias("i"), F.col("cluster").alias("group"))
    return reports.chords(X.nearest(X.second_order(X.prepare(W_top(spark, sf), 10)), 5), groups, 0.01)


@query("tune_subset", "s AS (SELECT vec_id FROM embeddings ORDER BY md5('529:' || vec_id), vec_id LIMIT 100), " + TOP_SQL + f" SELECT i, j, {r('w')} AS w FROM p WHERE i IN (SELECT vec_id FROM s) AND j IN (SELECT vec_id FROM s)")
def _(spark, sf):
    s = filtering.draw_samples(labels(spark, sf).select("sample_idx"), 100, 529)
    return filtering.subset_matrix(X.prepare(W_top(spark, sf), 10), s)


@query("tree_edges", N_SQL + f", c AS (SELECT tree, node, CASE WHEN node < 8 THEN 2 * node END AS lf, depth, (16 // pow(2, depth)::INT)::INT AS size FROM n) SELECT a.tree, a.node AS \"from\", b.node AS \"to\", {r('1.0 / b.depth')} AS inv_depth, {r('b.size / a.size::DOUBLE')} AS share FROM c a JOIN c b ON a.tree = b.tree AND b.node // 2 = a.node")
def _(spark, sf):
    n = N(spark)
    k = F.col("node")
    return importance.edges_of_trees(n.select("tree", "node", (2 * k).alias("left"), (2 * k + 1).alias("right"), (k >= 8).alias("is_leaf"), "depth", F.floor(16 / F.pow(F.lit(2.0), "depth")).cast("int").alias("nodesize")))


# kernels: no SQL


def two_blocks(spark, sf, scale: bool = True):
    d = B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding", "label"])
    got = d.orderBy("vec_id").toPandas()
    x = np.stack(got["embedding"]).astype(float)
    if scale:
        x = (x - x.mean(0)) / x.std(0, ddof=1)
    return x[:, :32], x[:, 32:], got["label"].to_numpy()


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A directed forest of block A on block B, second-order similarity of its weights, spectral clusters; their agreement
    with the labels."""
    a, b, label = two_blocks(spark, sf)
    f = forest.fit(spark, b, a, forest.Control(trees=20, nsplit=10))
    s = X.second_order(X.prepare(leaves.forest_weights(f.membership), 10))
    found = pipeline.cluster_similarity(pipeline.dense(s, len(label)), 10)["labels"]
    pairs = spark.createDataFrame([(int(p), int(q)) for p, q in zip(found, label, strict=True)], "pred int, ref int")
    return metrics.agreement(pairs)


query("flagship")(flagship)


@query("forest_supervised")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    return forest.fit(spark, b, a, forest.Control(trees=16)).nodes.drop("y_stats")


@query("forest_unsup")
def _(spark, sf):
    return forest.fit(spark, two_blocks(spark, sf)[0], None, forest.Control(trees=8, nodesize=3)).membership


@query("forest_classes")
def _(spark, sf):
    a, _b, l = two_blocks(spark, sf)  # noqa: E741
    f, _levels = forest.fit_classes(spark, a, l.tolist(), forest.Control(trees=12, nodesize=1))
    classes = reports.labels_frame(spark, range(len(l)), l).select("sample_idx", F.col("cluster").alias("class"))
    return forest.class_predictions(forest.class_probabilities(leaves.forest_weights(f.membership), classes))


@query("forest_subsampled")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    parts = forest.fit_subsampled(spark, b, a, n_sub=3, trees=5)
    return forest.average([leaves.forest_weights(p["forest"].membership) for p in parts], ["i", "j"], "w")


def _similarity(spark, sf):
    n = labels(spark, sf).count()
    return pipeline.dense(X.second_order(X.prepare(W(spark, sf), 10)), n), n


@query("spectral_labels")
def _(spark, sf):
    s, n = _similarity(spark, sf)
    return reports.labels_frame(spark, range(n), C.spectral(s)["labels"])


@query("pam_labels")
def _(spark, sf):
    s, n = _similarity(spark, sf)
    return reports.labels_frame(spark, range(n), C.pam_tuned(np.maximum(1 - s / s.max(), 0), range(2, 6))["labels"])


@query("mixture_post")
def _(spark, sf):
    return selection.by_mixture(selection.mixture_posteriors(_imd(spark)))


@query("adaptive_filter")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    control = forest.Control(trees=4, nodesize=8)
    f = forest.fit(spark, b, a, control)
    weights = {}
    for side, column, names in (("X", "split_var", f.x_names), ("Y", "msrv", f.y_names)):
        mean = dict(importance.per_tree(f.nodes, column).groupBy("var").agg((F.sum("imd") / 4).alias("w")).collect())
        weights[side] = {n: mean.get(k, 0.0) for k, n in enumerate(names)}
    got = selection.adaptive(weights, pipeline.refit_errors(spark, b, a, f.x_names, f.y_names, control), [0.8, 1.0, 1.2, 1.4], 2)
    return spark.createDataFrame([(float(t), float(e), t == got["tau"]) for t, e in got["trace"]], "tau double, error double, chosen boolean")


@query("path_importance")
def _(spark, sf):
    a, b, l = two_blocks(spark, sf)  # noqa: E741
    f = forest.fit(spark, b, a, forest.Control(trees=6, nodesize=20))
    return importance.path_importance(f, reports.labels_frame(spark, range(len(l)), l).withColumn("sample_idx", F.col("sample_idx").cast("int")))


@query("cluster_imd")
def _(spark, sf):
    a, b, l = two_blocks(spark, sf)  # noqa: E741
    f = forest.fit(spark, b, a, forest.Control(trees=6, nodesize=20))
    return importance.cluster_imd(f, reports.labels_frame(spark, range(len(l)), l).withColumn("sample_idx", F.col("sample_idx").cast("int")))[0]


@query("enhanced_forest_prox")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    return leaves.enhanced_of(forest.fit(spark, b, a, forest.Control(trees=6, nodesize=10)))


@query("merged_leaves")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    f = forest.fit(spark, b, a, forest.Control(trees=6, nodesize=10))
    return merging.merged_membership(f, leaves.embeddings_of(f))


@query("reconstruct_spectral")
def _(spark, sf):
    n = labels(spark, sf).count()
    return reports.labels_frame(spark, range(n), reconstruct.reconstruct_and_cluster(two_models(spark, sf), two_scores(spark), n, 4)["labels"])


@query("ensemble_importance")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    parts = reconstruct.fit_connections_subsampled(spark, {"A": (a, None), "B": (b, None)}, [("A", "B")], n_sub=3, trees=4, small=20, least_y=8, least_x=8)[0]
    return reconstruct.ensemble_importance(parts)


# the measuring set: 50 trees, all samples


@query("bench_weights")
def _(spark, sf):
    e = B.from_arrays(B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding"]), "vec_id", "embedding", {"A": (0, 50)})
    m = e.select(F.col("feature_idx").alias("tree"), "sample_idx", F.floor(100 * F.col("value")).cast("int").alias("leaf"), F.lit(1).alias("inbag"))
    return leaves.forest_weights(m)


@query("bench_second_order")
def _(spark, sf):
    e = B.from_arrays(B.read_table(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding"]), "vec_id", "embedding", {"A": (0, 50)})
    m = e.select(F.col("feature_idx").alias("tree"), "sample_idx", F.floor(100 * F.col("value")).cast("int").alias("leaf"), F.lit(1).alias("inbag"))
    return X.second_order(X.prepare(leaves.forest_weights(m, top=50), 50))


@query("bench_forest")
def _(spark, sf):
    a, b, _l = two_blocks(spark, sf)
    return forest.fit(spark, b, a, forest.Control(trees=50)).nodes.drop("y_stats")


@query("stability")
def _(spark, sf):
    s, n = _similarity(spark, sf)
    w = X.second_order(X.prepare(W(spark, sf), 10))
    base = C.spectral(s, [4])["labels"]
    fit = pipeline.Fit(spark, {}, None, list(range(n)), [])
    return pipeline.stability(fit, w, base, 4, repetitions=6)["base"]


@query("tsne")
def _(spark, sf):
    s, _n = _similarity(spark, sf)
    from thicket.functions.tsne import tsne

    y = tsne(s + 1e-6, rounds=60, seed=1)["embedding"]
    return spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(y)], "sample_idx int, x double, y double")


@query("ao_fusion")
def _(spark, sf):
    n = labels(spark, sf).count()
    two = X.prepare(two_models(spark, sf), 10, ["model"])
    got = C.fuse_alternating([pipeline.dense(two.where(F.col("model") == m), n) for m in ("A_B", "B_A")], 4)
    return spark.createDataFrame([("A_B", float(got["shares"][0])), ("B_A", float(got["shares"][1]))], "model string, alpha double")


@query("simulate")
def _(spark, sf):
    return simulate.simulate_blocks(spark, 200)[0]


@query("pipeline_full")
def _(spark, sf):
    long = simulate.simulate_blocks(spark, 120, {"methyl": 12, "gene": 10})[0]
    fit = pipeline.run(spark, long, trees=20, filter_mode="none", run_imd=True, select_rule="threshold")
    return fit.tidy_clusters()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
