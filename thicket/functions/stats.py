"""Numbers that neither Spark nor numpy has: tails, digamma, quantiles, ranks, simplex projection, density mode."""

from __future__ import annotations

import math

import numpy as np


def average_ranks(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def spearman(x, y) -> float:
    """Rank correlation; 0 where it is undefined."""
    a, b = np.asarray(x, float), np.asarray(y, float)
    if len(a) < 2 or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return 0.0
    a, b = average_ranks(a) - (len(a) + 1) / 2, average_ranks(b) - (len(b) + 1) / 2
    scale = math.sqrt(float((a * a).sum() * (b * b).sum()))
    return float((a * b).sum()) / scale if scale > 0 else 0.0


def quantile(x, q: float, kind: int = 7) -> float:
    method = {7: "linear", 8: "median_unbiased"}[kind]
    return float(np.quantile(np.asarray(x, float), q, method=method))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    if not math.isfinite(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def project_simplex(v) -> np.ndarray:
    """The nearest point whose parts are not negative and add up to 1."""
    v = np.asarray(v, float)
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)


def density_mode(x, points: int = 512) -> float:
    """Where a Gaussian kernel density, with the rule-of-thumb bandwidth, is highest."""
    x = np.asarray(x, float)
    spread = min(x.std(ddof=1), (quantile(x, 0.75) - quantile(x, 0.25)) / 1.34) or x.std(ddof=1) or abs(x[0]) or 1.0
    h = 0.9 * spread * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, points)
    dense = np.zeros(points)
    for part in np.array_split(x, max(1, len(x) // 4096)):
        dense += np.exp(-0.5 * ((grid[:, None] - part) / h) ** 2).sum(1)
    return float(grid[dense.argmax()])


def principal_scores(x: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first k components of centred and scaled columns; constant columns are left out."""
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0))[:, sd > 0] / sd[sd > 0]
    if not z.size:
        return np.zeros((len(x), 1))
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    k = max(1, min(k, z.shape[1], len(x) - 1))
    return u[:, :k] * s[:k]
