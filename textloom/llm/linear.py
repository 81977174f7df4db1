"""Sparse binary features and small linear models, fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


def csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) indices of binary feature rows."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    return r, np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)


def times(at, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at[0], w[at[1]], n)


def times_t(at, g: np.ndarray, m: int) -> np.ndarray:
    return np.bincount(at[1], g[at[0]], m)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(at, y: np.ndarray, m: int, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression by accelerated gradient descent."""
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    per_row = np.bincount(at[0], minlength=n).max(initial=0) + 1
    step = 1 / (0.25 * per_row * max(weight.max(initial=1), 1e-9) * n / total + l2 / total)
    rate = np.clip((weight * y).sum() / total, 1e-4, 1 - 1e-4)
    w, b = np.zeros(m), float(np.log(rate / (1 - rate)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = weight * (sigmoid(times(at, v, n) + c) - y) / total
        nw, nb = v - step * (times_t(at, g, m) + l2 / total * v), c - step * g.sum() * per_row**0.5
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate scores: Newton steps on a two-parameter logistic fit, lightly damped."""
    a, b = 1.0, 0.0
    if len(z) < 2 or y.min() == y.max():
        return a, b
    for _ in range(50):
        p = sigmoid(a * z + b)
        d, h = p - y, p * (1 - p)
        g = np.array([(d * z).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
        H = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        s = np.linalg.solve(H, g)
        a, b = a - np.clip(s[0], -2, 2), b - np.clip(s[1], -2, 2)
        if np.abs(s).max() < 1e-7:
            break
    return float(a), float(b)
