"""Checks of arguments: each returns what it accepts, in the form that the library works with, or raises ValueError."""

from __future__ import annotations

import math

import numpy as np

LARGEST = 2**31 - 1


def seed(value) -> int:
    """One finite whole number of 32 bits."""
    if isinstance(value, bool) or not isinstance(value, (int, float, np.number)) or not math.isfinite(value) or value != int(value) or abs(value) > LARGEST:
        raise ValueError("seed must be one whole number")
    return int(value)


def flag(value, label: str) -> bool:
    if not isinstance(value, (bool, np.bool_)):
        raise ValueError(f"{label} must be true or false")
    return bool(value)


def choice(value, choices, label: str) -> str:
    if value not in choices:
        raise ValueError(f"{label} must be one of {', '.join(choices)}, not {value!r}")
    return value


def square(w) -> np.ndarray:
    """A numeric, square matrix with a row at least."""
    w = np.asarray(w)
    if w.ndim != 2 or not w.size or w.shape[0] != w.shape[1] or not np.issubdtype(w.dtype, np.number):
        raise ValueError("a weight matrix must be numeric, square and not empty")
    return w


def variable_weights(weights, features: list[str], label: str) -> list[float] | None:
    """Weights of features, by name or in order, that sum to 1."""
    if weights is None:
        return None
    if isinstance(weights, dict):
        if set(weights) != set(features):
            raise ValueError(f"{label} must name each feature once")
        weights = [weights[f] for f in features]
    w = [float(x) for x in weights]
    if len(w) != len(features) or not all(math.isfinite(x) and x >= 0 for x in w) or sum(w) <= 0:
        raise ValueError(f"{label} must be {len(features)} finite numbers, none below 0 and one above")
    return [x / sum(w) for x in w]


def level(value, block: str, default: float = 0.05) -> float:
    """A block's level between 0 and 1, of one number, of a mapping (its first value where the block is absent) or of 'auto'."""
    if isinstance(value, str) and value == "auto":
        return default
    if isinstance(value, dict):
        value = value.get(block, next(iter(value.values()), None))
    if isinstance(value, bool) or not isinstance(value, (int, float, np.number)) or not 0 < value < 1:
        raise ValueError(f"the level of block {block} must lie between 0 and 1")
    return float(value)


def per_block(k, blocks: list[str]) -> dict[str, int | None]:
    """The number of clusters of each block, None where it is to be tuned: of one number, of a mapping, or of None."""
    if k is None or isinstance(k, dict):
        return {b: None if k is None or k.get(b) is None else int(k[b]) for b in blocks}
    if isinstance(k, bool) or not isinstance(k, (int, float, np.number)) or k != int(k):
        raise ValueError("k must be None, one whole number or a mapping of blocks to numbers")
    return {b: int(k) for b in blocks}


def aligned(labels, samples: list) -> list:
    """Labels in the samples' order: by name from a mapping that has all of them, else as many as there are samples."""
    if isinstance(labels, dict):
        if any(s not in labels for s in samples):
            raise ValueError("labels lack some samples")
        return [labels[s] for s in samples]
    if len(labels) != len(samples):
        raise ValueError("labels and samples differ in number")
    return list(labels)
