"""Choosing how many neighbours to keep: candidate grids, entropies of all candidates in one job, elbow and knee."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.functions import cluster as C
from thicket.operators import fusion
from thicket.operators import matrix as M
from thicket.plans.session import cut
from thicket.sources import checks


def grid(lower: float, upper: float, by: float = 1, most: int | None = None) -> list[int]:
    """Whole candidates from lower to upper, `most` or a few more at most, upper among them."""
    if not all(map(math.isfinite, (lower, upper, by))) or by <= 0 or upper < lower:
        return []
    step = by
    if most and most >= 2 and math.floor((upper - lower) / by) + 1 > most:
        step = math.ceil((upper - lower) / (most - 1))
    out = list(dict.fromkeys(int(lower + k * step) for k in range(math.floor((upper - lower) / step) + 1)))
    return out + [int(upper)] * (int(upper) not in out)


def no_cut(v: float | None, n: int, floor: bool = False) -> bool:
    """A cut-off of four fifths of the samples or more cuts nothing."""
    return v is None or math.isinf(v) or v >= (int(0.8 * n) if floor else math.ceil(0.8 * n))


def ranked(weights: DataFrame, by=("model",)) -> DataFrame:
    """Adjusted weights with their rank in the row: written once, any cut-off is then a filter."""
    order = Window.partitionBy(*by, "i").orderBy(F.desc(F.round("w", M.DIGITS)))
    return cut(M.adjust(weights, by).withColumn("rk", F.rank().over(order)))


def candidate_entropies(weights: DataFrame, alphas: DataFrame, candidates: list[int], n: int) -> DataFrame:
    """v, entropy of the fused matrix for every cut-off of the models' rows, in one job keyed by v."""
    spark = weights.sparkSession
    vs = spark.createDataFrame([(v,) for v in candidates], "v int")
    cutoff = ranked(weights).join(F.broadcast(vs), F.col("rk") <= F.col("v")).drop("rk")
    ready = M.normalise_rows(cutoff, ["v", "model"])
    mixed = ready.join(F.broadcast(alphas), "model").groupBy("v", "response", "i", "j").agg(F.sum(F.col("alpha") * F.col("w")).alias("w"))
    k = alphas.select("response").distinct().count()
    every = M.normalise_rows(mixed, ["v", "response"]).groupBy("v", "i", "j").agg((F.sum("w") / k).alias("w"))
    return M.mean_entropy(every, n, ["v"])


def elbow_table(curve: DataFrame, window: int = 3) -> DataFrame:
    """v, entropy, delta, gain (not negative), smooth (trailing mean of gains), of (v, entropy)."""
    order = Window.orderBy("v")
    d = curve.withColumn("delta", F.col("entropy") - F.lag("entropy").over(order)).withColumn("gain", F.greatest("delta", F.lit(0.0)))
    d = d.withColumn("gain", F.when(F.col("delta").isNotNull(), F.col("gain")))
    return d.withColumn("smooth", F.when(F.col("gain").isNotNull(), F.avg("gain").over(order.rowsBetween(1 - window, 0))))


def trailing_mean(x: list[float], window: int = 3) -> list[float]:
    out = []
    for k in range(len(x)):
        part = [v for v in x[max(0, k - window + 1) : k + 1] if v == v and math.isfinite(v)]
        out.append(sum(part) / len(part) if part else math.nan)
    return out


def knee(v: list[float], entropy: list[float], first: int, window: int = 3) -> tuple[int, str]:
    """Place farthest above the diagonal, from `first` (counted from 1) on."""
    n = len(entropy)
    first = min(max(2, first), n)
    y = [s if s == s else e for s, e in zip(trailing_mean(entropy, window), entropy, strict=True)]
    if n <= 2 or min(v) == max(v) or min(y) == max(y):
        return first, "first"
    above = [(b - min(y)) / (max(y) - min(y)) - (a - min(v)) / (max(v) - min(v)) for a, b in zip(v, y, strict=True)]
    places = range(first, max(2, n - 1) + 1)
    best = max(places, key=lambda k: (above[k - 1], -k), default=None)
    return (best, "knee") if best and above[best - 1] > 0 else (first, "first")


def elbow(v: list[float], entropy: list[float], rel_tol: float = 0.25, abs_tol: float = 1e-4, least: int = 4, share: float = 0.2, patience: int = 2, window: int = 3) -> tuple[int | None, str]:
    """Place (from 1) from which `patience` smoothed gains in a row are small; else the knee."""
    n = len(entropy)
    if not n:
        return None, "none"
    gains = [max(b - a, 0.0) for a, b in zip(entropy, entropy[1:], strict=False)]
    smooth = [math.nan, *trailing_mean(gains, window)]
    limit = max(abs_tol, rel_tol * max([s for s in smooth[1:] if math.isfinite(s)], default=0.0))
    first = min(max(least, math.ceil(share * n), 2), n)
    for k in range(first, n - patience + 2):
        if all(math.isfinite(s) and s <= limit for s in smooth[k - 1 : k - 1 + patience]):
            return k, "small gain"
    return knee(v, entropy, first, window)


def fused_most(n: int, share: float = 1.0) -> int:
    """The largest cut-off to try for a matrix of n samples."""
    if not math.isfinite(n) or not math.isfinite(share) or n <= 0 or share <= 0:
        raise ValueError("n and share must be finite and above 0")
    return max(1, min(math.ceil(share * int(n)), int(n)))


def until_elbow(candidates: list, entropy_of, **options) -> list[tuple]:
    """(candidate, entropy) rows in order, up to the candidate at which the elbow by small gains is seen."""
    rows: list[tuple] = []
    for v in candidates:
        rows.append((v, float(entropy_of(v))))
        if len(rows) > 1 and elbow([r[0] for r in rows], [r[1] for r in rows], **options)[1] == "small gain":
            break
    return rows


def evaluate(s, k: int | None = None) -> dict:
    """cost, silhouette, largest gap and k of the spectral clusters of a similarity; None where there is nothing to cluster."""
    s = np.asarray(s, float)
    s = np.where(np.isfinite(s), s, 0.0)
    s = (s + s.T) / 2
    np.fill_diagonal(s, 0)
    if len(s) < 3 or np.abs(s).sum() <= np.finfo(float).eps:
        return {"cost": None, "silhouette": None, "gap": None, "k": k}
    found = C.spectral(s, [k] if k else range(2, min(12, len(s) - 1) + 1))
    return {"cost": float(found["cost"]), "silhouette": found["silhouette"], "gap": float(max(found["gaps"])), "k": len(set(found["labels"].tolist()))}


def best_rows(rows: list[dict], by: str = "cost") -> list[dict]:
    """Of rows (v, k, cost, silhouette, gap, entropy) the best for each k: the first of least cost, or of largest silhouette
    or gap. by elbow: the one row at the elbow of entropy over v; without entropies the first one that cuts nothing, else the
    one of least v."""
    checks.choice(by, ("cost", "silhouette", "gap", "elbow"), "by")
    if not rows:
        raise ValueError("there are no rows to choose from")
    if by == "elbow":
        known = sorted((r for r in rows if r.get("entropy") is not None and math.isfinite(r["entropy"])), key=lambda r: r["v"])
        if not known:
            return [next((r for r in rows if r.get("no_cut")), min(rows, key=lambda r: r["v"]))]
        place, _ = elbow([r["v"] for r in known], [r["entropy"] for r in known])
        return [known[min(place or 4, len(known)) - 1]]
    sign = 1 if by == "cost" else -1
    best: dict = {}
    for r in rows:
        if r[by] is not None and (r["k"] not in best or sign * r[by] < sign * best[r["k"]][by]):
            best[r["k"]] = r
    return [best[k] for k in sorted(best)]


def tune_model_top(weights: DataFrame, scores: DataFrame, n: int, least: int = 10, most: int = 20) -> dict:
    """The models' cut-off by the elbow of the fused matrix's entropy."""
    alphas = cut(fusion.shares(scores))
    candidates = grid(min(least, n), n, 1, most)
    rows = sorted(map(tuple, candidate_entropies(weights, alphas, candidates, n).collect()))
    place, rule = elbow([v for v, _ in rows], [e for _, e in rows])
    best = rows[place - 1][0] if place else None
    return {"v": None if no_cut(best, n) else best, "rule": rule, "curve": rows}


def tune_fused_top(fused: DataFrame, n: int, least: int = 10, most: int = 20) -> dict:
    """The overall matrix's cut-off in the same way."""
    spark = fused.sparkSession
    candidates = grid(min(least, n), n, 1, most)
    order = Window.partitionBy("i").orderBy(F.desc(F.round("w", M.DIGITS)))
    rk = cut(fused.withColumn("rk", F.rank().over(order)))
    vs = spark.createDataFrame([(v,) for v in candidates], "v int")
    rows = sorted(map(tuple, M.mean_entropy(rk.join(F.broadcast(vs), F.col("rk") <= F.col("v")), n, ["v"]).collect()))
    place, rule = elbow([v for v, _ in rows], [e for _, e in rows])
    best = rows[place - 1][0] if place else None
    return {"v": None if no_cut(best, n) else best, "rule": rule, "curve": rows}
