"""Noise or signal: a two-component mixture of positive importances, beside the mass at zero."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np

from thicket.functions.stats import digamma, quantile

_LOG_ROOT = 0.5 * math.log(2 * math.pi)


def _log_normal(x, mean, sd):
    return -0.5 * ((x - mean) / sd) ** 2 - math.log(sd) - _LOG_ROOT


def _log_tail(z: float) -> float:
    """log P(Z > z), also far out."""
    if z < 30:
        return math.log(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-320)) if z > -30 else 0.0
    return -0.5 * z * z - math.log(z) - _LOG_ROOT + math.log1p(-1 / (z * z))


@dataclass
class Mixture:
    """posterior: noise, signal, zero of each value."""

    posterior: np.ndarray
    means: tuple[float, float]
    trace: list[float]
    degenerate: bool = False
    rolled_back: bool = False


def _normal_fit(x, w, low):
    mean = float((w * x).sum() / w.sum())
    return mean, max(math.sqrt(float((w * (x - mean) ** 2).sum() / w.sum())), low)


def _truncated_fit(x, w, mean, sd, low):
    """Weighted likelihood of a normal cut off below 0, by Newton steps with halving on (mean, log sd)."""
    def loss(p):
        s = math.exp(p[1])
        return -float((w * (_log_normal(x, p[0], s) - _log_tail(-p[0] / s))).sum())

    clip = lambda p: np.array([min(1.0, max(-20.0, p[0])), min(math.log(10), max(math.log(low), p[1]))])
    p = clip(np.array([mean, math.log(max(sd, low))]))
    now = loss(p)
    for _ in range(60):
        h = np.array([1e-5 * max(sd, low), 1e-5])
        e = np.diag(h)
        g = np.array([(loss(p + e[i]) - loss(p - e[i])) / (2 * h[i]) for i in range(2)])
        hess = np.array([[(loss(p + e[i] + e[j]) - loss(p + e[i] - e[j]) - loss(p - e[i] + e[j]) + loss(p - e[i] - e[j])) / (4 * h[i] * h[j]) for j in range(2)] for i in range(2)])
        try:
            value, axes = np.linalg.eigh(hess)
            step = -axes @ ((axes.T @ g) / np.maximum(np.abs(value), 1e-8))
        except np.linalg.LinAlgError:
            break
        for _ in range(30):
            new = clip(p + step)
            if (other := loss(new)) < now:
                break
            step = step / 2
        else:
            break
        done = now - other < 1e-12 * max(1.0, abs(now))
        p, now = new, other
        if done:
            break
    return float(p[0]), max(math.exp(p[1]), low)


def _gamma_fit(x, w, shape):
    mean = float((w * x).sum() / w.sum())
    goal = max(math.log(mean) - float((w * np.log(x)).sum() / w.sum()), 0.0)
    if goal <= 1e-12:
        shape = 1e6
    else:
        off = lambda k: math.log(k) - digamma(k) - goal
        low, high = 1e-6, max(1.0, shape)
        while off(high) > 0 and high < 1e8:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if off(mid) > 0 else (low, mid)
        shape = (low + high) / 2
    shape = min(max(shape, 1e-6), 1e8)
    return shape, max(mean / shape, 2.3e-308)


def fit_mixture(values, rounds: int = 1000, tol: float = 1e-5, noise: str = "normal", signal: str = "normal") -> Mixture:
    """EM for values in [0, 1]. noise: normal or truncated; signal: normal or gamma. A step that lowers the likelihood is
    taken back and ends the fit. The component with the lower mean is the noise."""
    x = np.asarray(values, float)
    if not np.isfinite(x).all() or (x < 0).any() or (x > 1).any():
        raise ValueError("importances must be finite and within [0, 1]")
    post = np.zeros((len(x), 3))
    zero = x == 0
    post[zero, 2] = 1
    v = x[~zero]
    if not len(v):
        return Mixture(post, (0.0, 0.0), [])
    spread = float(v.std(ddof=1)) if len(v) > 1 else 0.0
    if spread < math.sqrt(np.finfo(float).eps):
        warnings.warn("positive importances hardly vary; all count as noise", stacklevel=2)
        post[~zero, 0] = 1
        return Mixture(post, (float(v.mean()),) * 2, [], degenerate=True)
    low = max(spread * 1e-3, 1e-6)
    m1, m2 = quantile(v, 0.3, 8), quantile(v, 0.7, 8)
    s1 = s2 = max(spread / 2, low)
    p = {"mix": 0.5, "a": (m1, s1), "b": (m2, s2), "g": (max((m2 / s2) ** 2, 1e-3), max(s2**2 / m2, 1e-6))}

    def logs(p):
        mean, sd = p["a"][0], max(p["a"][1], low)
        one = _log_normal(v, mean, sd) - (_log_tail(-mean / sd) if noise == "truncated" else 0.0)
        if signal == "gamma":
            k, t = max(p["g"][0], 1e-6), max(p["g"][1], 2.3e-308)
            two = (k - 1) * np.log(v) - v / t - math.lgamma(k) - k * math.log(t)
        else:
            two = _log_normal(v, p["b"][0], max(p["b"][1], low))
        one, two = one + math.log(p["mix"]), two + math.log1p(-p["mix"])
        return one, two, np.logaddexp(one, two)

    trace, back = [], False
    for _ in range(rounds):
        one, _two, both = logs(p)
        r, ll = np.exp(one - both), float(both.sum())
        trace.append(ll)
        if r.sum() <= 1e-8 or (1 - r).sum() <= 1e-8:
            break
        new = dict(p, mix=min(1 - 1e-6, max(1e-6, float(r.mean()))))
        new["a"] = _truncated_fit(v, r, *p["a"], low) if noise == "truncated" else _normal_fit(v, r, low)
        if signal == "gamma":
            new["g"] = _gamma_fit(v, 1 - r, p["g"][0])
        else:
            new["b"] = _normal_fit(v, 1 - r, low)
        after = float(logs(new)[2].sum())
        if not math.isfinite(after) or after < ll:
            back = True
            break
        p = new
        if abs(after - ll) <= tol:
            trace.append(after)
            break
    one, two, both = logs(p)
    pair = np.stack([np.exp(one - both), np.exp(two - both)], 1)
    mean, sd = p["a"]
    first = mean + sd * math.exp(-0.5 * (mean / sd) ** 2 - _LOG_ROOT - _log_tail(-mean / sd)) if noise == "truncated" else mean
    second = p["g"][0] * p["g"][1] if signal == "gamma" else p["b"][0]
    post[~zero, :2] = pair[:, ::-1] if first > second else pair
    return Mixture(post, (min(first, second), max(first, second)), trace, rolled_back=back)
