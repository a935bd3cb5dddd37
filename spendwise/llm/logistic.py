"""Logistic regression on sparse rows, for bounded training samples."""
from __future__ import annotations

import numpy as np


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, target: np.ndarray, width: int,
        l2: float = 1e-4, steps: int = 150, rate: float = 0.2, hold_bias: bool = False) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean log loss with soft targets; entries (row, col, value).
    ``hold_bias`` keeps the bias at the log odds of the mean target, the score of a
    row without any known entry.  Returns weights and bias.  Deterministic."""
    rate_1 = min(max(float(np.mean(target)) if len(target) else 0.5, 1e-6), 1 - 1e-6)
    w, bias = np.zeros(width), float(np.log(rate_1 / (1 - rate_1))) if hold_bias else 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n = max(1, len(target))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col] * value, minlength=len(target)) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        g = np.append(np.bincount(col, weights=miss[row] * value, minlength=width) + l2 * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, bias = w - step[:-1], bias - (0.0 if hold_bias else step[-1])
    return w, float(bias)
