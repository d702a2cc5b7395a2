"""t-SNE of a similarity matrix that serves as the joint probabilities itself."""

from __future__ import annotations

import numpy as np


def probabilities(s: np.ndarray) -> np.ndarray:
    """Symmetric, hollow, of total 1."""
    s = np.asarray(s, float)
    if s.ndim != 2 or s.shape[0] != s.shape[1] or len(s) < 2:
        raise ValueError("needs a square matrix of two samples at least")
    if not np.isfinite(s).all() or (s < 0).any():
        raise ValueError("similarities must be finite and not negative")
    p = (s + s.T) / 2
    np.fill_diagonal(p, 0)
    if p.sum() <= 0:
        raise ValueError("no similarity off the diagonal is positive")
    return p / p.sum()


def kernel(y: np.ndarray) -> np.ndarray:
    sq = (y * y).sum(1)
    q = 1 / (1 + np.maximum(sq[:, None] + sq - 2 * y @ y.T, 0))
    np.fill_diagonal(q, 0)
    return q


def gradient(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    k = kernel(y)
    f = (p - k / k.sum()) * k
    return 4 * (f.sum(1)[:, None] * y - f @ y)


def tsne(similarity, dims: int = 2, rounds: int = 1000, rate: float = 200, tol: float = 1e-5, patience: int = 10, seed: int | None = None) -> dict:
    """Plain gradient descent, centred after each step; ends after `patience` steps in a row that change the cost by tol
    at most. The seed's generator is its own."""
    if min(dims, rounds, patience) < 1 or not rate > 0 or not tol >= 0:
        raise ValueError("dims, rounds and patience start at 1, the rate is positive, tol is not negative")
    p = probabilities(similarity)
    y = np.random.default_rng(seed).standard_normal((len(p), dims)) * 1e-4
    costs, calm, eps = [], 0, np.finfo(float).eps
    for _ in range(rounds):
        y = y - rate * gradient(y, p)
        y -= y.mean(0)
        if not np.isfinite(y).all():
            raise FloatingPointError("the embedding left the finite numbers")
        q = kernel(y)
        costs.append(float((p * np.log((p + eps) / (q / q.sum() + eps))).sum()))
        calm = calm + 1 if len(costs) > 1 and abs(costs[-1] - costs[-2]) <= tol else 0
        if calm >= patience:
            break
    return {"embedding": y, "costs": costs, "converged": calm >= patience, "rounds": len(costs)}
