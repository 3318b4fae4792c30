"""Binary maximum-entropy model over hashed features, fitted in numpy."""

from __future__ import annotations

from zlib import crc32

import numpy as np

#: Slots of the hashed weight vector; slot 0 is the bias, slot 1 padding.
SLOTS = 1 << 17


def slot(feature: str) -> int:
    return crc32(feature.encode()) % (SLOTS - 2) + 2


def matrix(rows: list[list[str]]) -> np.ndarray:
    """Feature slots of each row, padded with slot 1."""
    width = max((len(r) for r in rows), default=0)
    out = np.ones((len(rows), width + 1), np.int64)
    out[:, 0] = 0
    for i, r in enumerate(rows):
        out[i, 1 : len(r) + 1] = [slot(f) for f in r]
    return out


def prior(weights: dict[str, float], bias: float = 0.0) -> np.ndarray:
    """Weight vector with the given features set; the model is pulled towards it."""
    w = np.zeros(SLOTS)
    w[0] = bias
    for f, v in weights.items():
        w[slot(f)] = v
    return w


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w0: np.ndarray, l2: float = 4.0, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Weights minimising weighted log loss plus l2/2 * |w - w0|^2 (Adam, full batch)."""
    w, m, v = w0.copy(), np.zeros(SLOTS), np.zeros(SLOTS)
    if not len(x):
        return w
    flat = x.ravel()
    for t in range(1, steps + 1):
        z = w[x].sum(1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(flat, np.repeat(g, x.shape[1]), SLOTS) + l2 * (w - w0)
        grad[1] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def score(w: np.ndarray, rows: list[list[str]]) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    return w[matrix(rows)].sum(1)


def total(w: np.ndarray, features: list[str]) -> float:
    """Score of some of a row's features, without the bias."""
    return float(sum(w[slot(f)] for f in features))
