"""Growing forests: one task row for each tree, trees and leaves as relations.

The two matrices go to the executors as broadcasts of a checked size; trees are independent, each with random streams of
its own, so the forest doesn't depend on how trees are dealt to tasks. A forest is a pair of tables:
nodes(tree, node, left, right, depth, nodesize, split_var, split_val, is_leaf, score, msrv, y_stats) and
membership(tree, sample_idx, leaf, inbag), leaves numbered from left to right, inbag the number of draws."""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.functions import tree as kernel
from thicket.functions.rng import Stream, seed_chain
from thicket.plans.session import cut
from thicket.sources import checks

#: Bytes of both matrices, above which a forest refuses to broadcast and asks for a column-subsampled ensemble.
MATRIX_BYTES = 1 << 30
GROWN = (
    "conn_id int, rep int, tree int, node array<int>, left array<int>, right array<int>, depth array<int>, nodesize array<int>, split_var array<int>, split_val array<double>, "
    "score array<double>, msrv array<int>, y_stats array<map<int,double>>, leaf array<int>, inbag array<int>"
)


def resolve(value, p: int, default: str, name: str = "param") -> int:
    """A count, or a formula in p, as sqrt(p) or p/3; rounded up, 1 at least. Only arithmetic is read, nothing is run."""
    value = default if value is None else value
    if isinstance(value, str):
        names = {"p": p}
        calls = {"sqrt": math.sqrt, "log": math.log, "log2": math.log2, "ceiling": math.ceil, "ceil": math.ceil, "floor": math.floor, "round": round, "max": max, "min": min}
        binary = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: a**b}

        def of(n):
            if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
                return n.value
            if isinstance(n, ast.Name) and n.id in names:
                return names[n.id]
            if isinstance(n, ast.BinOp) and type(n.op) in binary:
                return binary[type(n.op)](of(n.left), of(n.right))
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
                return -of(n.operand)
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in calls and not n.keywords:
                return calls[n.func.id](*map(of, n.args))
            raise ValueError(f"{name}: {value!r} is not arithmetic in p")

        value = of(ast.parse(value.replace("^", "**"), mode="eval").body)
    if isinstance(value, bool) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must come to a positive number")
    return max(1, math.ceil(value))


@dataclass(frozen=True)
class Control:
    trees: int = 500
    mtry: int | str | None = None
    ytry: int | str | None = None
    nsplit: int = 10
    nodesize: int = 5
    max_depth: int = 0
    seed: int = 529
    with_replacement: bool = False
    x_weights: tuple | None = None
    y_weights: tuple | None = None

    def check(self) -> Control:
        checks.seed(self.seed)
        checks.flag(self.with_replacement, "with_replacement")
        for name, least in (("trees", 1), ("nsplit", 0), ("nodesize", 1), ("max_depth", 0)):
            v = getattr(self, name)
            if isinstance(v, bool) or v != int(v) or v < least:
                raise ValueError(f"{name} must be a whole number of {least} at least")
        return self


@dataclass
class Forest:
    """nodes and membership, with what is needed to read them."""

    nodes: DataFrame
    membership: DataFrame
    control: Control
    x_names: list[str]
    y_names: list[str]
    samples: list
    response: str = "Y"
    predictor: str = "X"
    x: np.ndarray | None = field(default=None, repr=False)
    y: np.ndarray | None = field(default=None, repr=False)


def check_matrix(m, label: str) -> np.ndarray:
    m = np.asarray(m, float)
    if m.ndim != 2 or m.shape[0] < 2 or m.shape[1] < 1:
        raise ValueError(f"{label} needs two rows and one column at least")
    if not np.isfinite(m).all():
        raise ValueError(f"{label} must hold finite numbers only")
    return m


def grow_one(x: np.ndarray, y: np.ndarray | None, c: Control, t: int, seeds) -> tuple[kernel.Tree, np.ndarray, np.ndarray]:
    """Tree t, the leaf of each sample and its number of draws. y None: unsupervised."""
    n, p = x.shape
    bag = kernel.bag_of(n, c.with_replacement, Stream(seeds[0][t]))
    if y is None:
        rng = np.random.default_rng([abs(c.seed), t])
        mtry, ytry = math.ceil(math.sqrt(p)), resolve(c.ytry, p, "15", "ytry")
        find = lambda rows: kernel.best_split_unsupervised(x, rows, mtry, min(ytry, max(1, p - 1)), c.nsplit, rng)
    else:
        rng = Stream(seeds[1][t])
        mtry, ytry = resolve(c.mtry, p, "p/3", "mtry"), resolve(c.ytry, y.shape[1], "p/3", "ytry")
        find = lambda rows: kernel.best_split(x, y, rows, mtry, ytry, c.nsplit, rng, c.x_weights, c.y_weights)
    grown = kernel.grow(x, bag, find, c.nodesize, c.max_depth)
    return grown, grown.route(x), np.bincount(bag, minlength=n)


def grow_trees(spark: SparkSession, jobs: list[dict]) -> DataFrame:
    """GROWN rows of all trees of all jobs in one Spark job. A job: conn_id, rep, x, y (or None), control; x and y are matrices
    or kernel.Picked columns of them. A matrix that several jobs read is broadcast once."""
    wholes: list[np.ndarray] = []

    def place(m):
        whole, columns = (m.whole, m.columns) if isinstance(m, kernel.Picked) else (m, None)
        k = next((k for k, w in enumerate(wholes) if w is whole), len(wholes))
        wholes.extend([whole] * (k == len(wholes)))
        return k, columns

    placed = [(j["conn_id"], j["rep"], place(j["x"]), None if j["y"] is None else place(j["y"]), j["control"], seed_chain(abs(j["control"].seed), j["control"].trees)) for j in jobs]
    size = sum(w.nbytes for w in wholes)
    if size > MATRIX_BYTES:
        raise ValueError(f"the matrices have {size} bytes; above {MATRIX_BYTES} fit a column-subsampled ensemble")
    held = spark.sparkContext.broadcast((wholes, placed))
    index = [(k, t) for k, j in enumerate(jobs) for t in range(j["control"].trees)]
    tasks = min(len(index), 4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        there, every = held.value
        read = lambda p: None if p is None else there[p[0]] if p[1] is None else kernel.Picked(there[p[0]], p[1])
        for pdf in batches:
            for k, t in zip(pdf["job"], pdf["t"], strict=True):
                conn, rep, x, y, c, seeds = every[k]
                x, y = read(x), read(y)
                grown, leaf, draws = grow_one(x, y, c, int(t), seeds)
                number = grown.preorder_leaves()
                yield pd.DataFrame([{
                    "conn_id": conn, "rep": rep, "tree": t, "node": list(range(len(grown.left))), "left": grown.left, "right": grown.right, "depth": grown.depth, "nodesize": grown.size,
                    "split_var": grown.var, "split_val": grown.cut, "score": grown.score, "msrv": grown.msrv, "y_stats": grown.stats,
                    "leaf": [number[v] for v in leaf.tolist()], "inbag": draws.tolist(),
                }])

    trees = spark.createDataFrame(index, "job int, t int").repartition(tasks)
    return cut(trees.mapInPandas(run, GROWN))


def tables(grown: DataFrame, samples: list) -> tuple[DataFrame, DataFrame]:
    """nodes and membership of grown trees."""
    keys = ["conn_id", "rep", "tree"]
    parts = ["node", "left", "right", "depth", "nodesize", "split_var", "split_val", "score", "msrv", "y_stats"]
    nodes = grown.select(*keys, F.inline(F.arrays_zip(*parts))).select(
        *keys, "node", "left", "right", "depth", "nodesize", "split_var", "split_val", (F.col("left") < 0).alias("is_leaf"), "score", F.when(F.col("msrv") >= 0, F.col("msrv")).alias("msrv"), "y_stats"
    )
    rows = grown.select(*keys, F.posexplode(F.arrays_zip("leaf", "inbag")).alias("sample_idx", "m")).select(*keys, "sample_idx", "m.leaf", "m.inbag")
    return nodes, rows


def fit(spark: SparkSession, x, y=None, control: Control = Control(), x_names=None, y_names=None, samples=None, response="Y", predictor="X") -> Forest:
    """A regression forest of y on x, or, without y, an unsupervised forest of x."""
    x = check_matrix(x, "X")
    y = None if y is None else check_matrix(y, "Y")
    if y is not None and len(x) != len(y):
        raise ValueError("X and Y must hold the same samples")
    control = control.check()
    grown = grow_trees(spark, [{"conn_id": 0, "rep": 0, "x": x, "y": y, "control": control}])
    return _forest(grown, x, y, control, x_names, y_names, samples, response, predictor)


def _forest(grown, x, y, control, x_names=None, y_names=None, samples=None, response="Y", predictor="X") -> Forest:
    nodes, membership = tables(grown, samples)
    name = lambda m, names, s: list(names) if names is not None else [f"{s}{k + 1}" for k in range(m.shape[1])]
    return Forest(nodes, membership, control, name(x, x_names, "x"), name(x if y is None else y, y_names, "y"), list(samples) if samples is not None else list(range(len(x))), response, predictor, x, y)


def fit_connections(spark: SparkSession, blocks: dict[str, tuple[np.ndarray, list[str]]], pairs, control: Control = Control(), samples=None) -> list[Forest]:
    """A forest for each (response, predictor), all grown in one job; a single block is fitted unsupervised."""
    jobs = []
    for k, pair in enumerate(pairs):
        x, y = blocks[pair[-1]][0], blocks[pair[0]][0]
        jobs.append({"conn_id": k, "rep": 0, "x": check_matrix(x, pair[-1]), "y": None if len(set(pair)) == 1 else check_matrix(y, pair[0]), "control": control.check()})
    grown = grow_trees(spark, jobs)
    return [_forest(grown.where(F.col("conn_id") == k), j["x"], j["y"], control, blocks[p[-1]][1], blocks[p[0]][1], samples, p[0], p[-1]) for k, (p, j) in enumerate(zip(pairs, jobs, strict=True))]


def fit_classes(spark: SparkSession, x, labels, control: Control | None = None, samples=None) -> tuple[Forest, list]:
    """A classification forest: the classes as one-hot responses, all of them tried at each node."""
    levels = sorted(set(labels))
    if len(levels) < 2:
        raise ValueError("two classes are needed at least")
    y = (np.asarray(labels)[:, None] == np.array(levels)).astype(float)
    control = control or Control(nodesize=1)
    control = replace(control, ytry=len(levels), mtry=control.mtry or "sqrt(p)")
    return fit(spark, x, y, control, samples=samples, y_names=list(map(str, levels))), levels


def class_probabilities(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """i, class, prob: forest weights summed by the donors' class and normalised by row."""
    votes = weights.join(labels.select(F.col("sample_idx").alias("j"), "class"), "j").groupBy("i", "class").agg(F.sum("w").alias("p"))
    return votes.withColumn("prob", F.col("p") / F.sum("p").over(Window.partitionBy("i"))).drop("p")


def class_predictions(probabilities: DataFrame) -> DataFrame:
    """The likeliest class of each sample; the first one wins ties."""
    order = Window.partitionBy("i").orderBy(F.desc(F.round("prob", 12)), "class")
    return probabilities.withColumn("k", F.row_number().over(order)).where("k = 1").select("i", F.col("class").alias("predicted"), "prob")


def fit_subsampled(spark: SparkSession, x, y, n_sub: int = 15, share_y: float = 0.2, share_x: float = 0.2, trees: int = 25, least_y: int = 20, least_x: int = 30, control: Control = Control()) -> list[dict]:
    """Forests on random columns, all grown in one job: dicts of forest, x_columns, y_columns."""
    x, y = check_matrix(x, "X"), check_matrix(y, "Y")
    rng, jobs = np.random.default_rng(control.seed), []
    size = lambda n, share, least: min(n, max(least, math.ceil(share * n)))
    for k in range(n_sub):
        xs, ys = np.sort(rng.choice(x.shape[1], size(x.shape[1], share_x, least_x), False)), np.sort(rng.choice(y.shape[1], size(y.shape[1], share_y, least_y), False))
        jobs.append({"conn_id": 0, "rep": k, "x": kernel.Picked(x, xs), "y": kernel.Picked(y, ys), "control": replace(control, trees=trees, seed=control.seed + k).check(), "xs": xs, "ys": ys})
    grown = grow_trees(spark, jobs)
    return [{"forest": _forest(grown.where(F.col("rep") == k), x[:, j["xs"]], y[:, j["ys"]], j["control"], [f"x{c + 1}" for c in j["xs"]], [f"y{c + 1}" for c in j["ys"]]), "x_columns": j["xs"], "y_columns": j["ys"]} for k, j in enumerate(jobs)]


def average(parts: list[DataFrame], keys: list[str], value: str, n: int | None = None) -> DataFrame:
    """Mean over n parts of long tables; what a part lacks counts 0."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg((F.sum(value) / (n or len(parts))).alias(value))
