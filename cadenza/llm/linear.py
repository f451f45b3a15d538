"""Sparse logistic regression on a bounded sample, in numpy on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights, the intercept last, of mean log loss + l1 |w| + l2 w^2 / 2, by accelerated proximal steps.

    `y` has a target a row, or a column for each of several models, which are fitted side by side.
    Columns of x are scaled to a mean square of one first (rare ones by a bound), so that rare and common
    features are learned alike; the weights returned are for the columns as given. The steps, their
    number and the start are fixed, so equal samples give equal weights.
    """
    n, d = x.shape
    targets = y.reshape(n, -1)
    w, z, t = np.zeros((d + 1, targets.shape[1])), np.zeros((d + 1, targets.shape[1])), 1.0
    if not n:
        return w if y.ndim > 1 else w[:, 0]
    scale = (np.sqrt(np.einsum("ij,ij->j", x, x) / n) + 1e-2).astype(x.dtype)
    x = x / scale
    v = np.full(d, 1.0, x.dtype)
    for _ in range(8):  # the largest eigenvalue of x'x / n
        u = x.T @ (x @ v) / n
        norm = float(np.linalg.norm(u)) or 1.0
        v = (u / norm).astype(x.dtype)
    rate = 1 / (0.25 * (norm + 1) + l2)
    for _ in range(steps):
        miss = (sigmoid((x @ z[:d].astype(x.dtype)).astype(np.float64) + z[d]) - targets) / n
        step = z - rate * np.vstack([x.T @ miss.astype(x.dtype) + l2 * z[:d], miss.sum(0)])
        new = step.copy()
        new[:d] = np.sign(step[:d]) * np.maximum(np.abs(step[:d]) - rate * l1, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    w = np.vstack([w[:d] / scale[:, None], w[d]])
    return w if y.ndim > 1 else w[:, 0]


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
