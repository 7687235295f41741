"""Linear classifiers in numpy and the labelled rows they are fitted on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(rows: DataFrame, label: str, per_class: int, max_chars: int = 20_000) -> tuple[list[tuple[str, object]], dict]:
    """About ``per_class`` (text, label) of each label, chosen by a hash of doc_id, and the rows that each label has.

    The bound on what reaches the driver: ``per_class`` times the labels, each text of ``max_chars`` at most; longer
    texts are passed over in fitting (never in scoring). ``rows`` has doc_id, text and ``label``; null labels don't count.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = {x[0]: x[1] for x in rows.groupBy(label).count().collect()}
    if not counts:
        return [], {}
    spin = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30))
    chosen: Column = F.lit(False)
    least = {value: min(1 << 30, int((1 << 30) * per_class / n)) for value, n in counts.items()}
    for value, below in least.items():
        chosen = chosen | ((F.col(label) == value) & (spin < below))
    rows = rows.where(spin < max(least.values()))  # on doc_id alone: Spark takes it below a join, before texts are moved
    got = rows.where(chosen).select("text", label, spin.alias("spin")).orderBy("spin", "text").limit(2 * per_class * len(counts)).collect()
    return [(x[0], x[1]) for x in got], counts


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent with restarts."""
    w, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        g = gradient(ahead)
        new = ahead - step * g
        if (g * (new - w)).sum() > 0:
            t = 1.0
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nt * (new - w)
        w, t = new, nt
    return w


def _norm(x: np.ndarray, weight: np.ndarray) -> float:
    """The largest eigenvalue of x'wx, for a diagonal w."""
    v = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), dtype=x.dtype)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v))
        v /= size + 1e-12
    return size


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 300, level: bool = True) -> np.ndarray:
    """Weights, the last one the bias, of a linear support vector machine (squared hinge). y: 1 or -1.

    ``level``: classes weigh alike; else rows do.
    """
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * len(y)
    weight = (weight if level else np.full(len(y), cost)).astype(x.dtype)
    keep = np.ones(x.shape[1], dtype=x.dtype)
    keep[-1] = 1e-3

    def gradient(w: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (x @ w))
        return keep * w - 2 * (x.T @ (weight * y * slack))

    return descend(gradient, np.zeros(x.shape[1], dtype=x.dtype), 1 / (1 + 2.1 * _norm(x, weight)), rounds).astype(np.float64)


def calibration(margin: np.ndarray, y: np.ndarray, level: bool = True) -> tuple[float, float]:
    """Slope and offset of the logistic function from margins to the probability of y = 1 (Platt); ``level`` as above."""
    good, n = y > 0, max(1, len(y))
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * n
    weight = weight if level else np.ones(len(y))
    x = np.column_stack([margin, np.ones(len(margin))])

    def gradient(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (weight * (p - target)) + 1e-3 * w

    a, b = descend(gradient, np.array([1.0, 0.0]), 4 / (1e-3 + _norm(x, weight)), 400)
    return float(max(a, 1e-3)), float(b)


def chances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (none below 0) and offset of the logistic function from features to the probability of y = 1; classes
    weigh alike, targets are Platt's."""
    good, n = y > 0, max(1, len(y))
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * n
    x = np.column_stack([x, np.ones(len(x))])

    def gradient(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (weight * (p - target)) + 1e-3 * w

    w = descend(gradient, np.zeros(x.shape[1]), 4 / (1e-3 + _norm(x, weight)), 2000)
    return np.append(np.maximum(w[:-1], 0), w[-1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
