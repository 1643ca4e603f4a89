"""The low-dimensional similarity 1 / (1 + a x^2b) of UMAP."""

from __future__ import annotations

import numpy as np


def fit_ab(min_dist: float, spread: float, rounds: int = 300, points: int = 300) -> tuple[float, float]:
    """(a, b) by plain gradient steps on 300 points of the target curve; a stays in 0.001 .. 10, b in 0.1 .. 2."""
    x = np.arange(points) * (3.0 * spread / (points - 1))
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    x, y = x[1:], y[1:]
    log_x = np.log(x)
    a = b = 1.0
    for _ in range(rounds):
        p = x ** (2 * b)
        d = 1 + a * p
        slope = (1 / d - y) / (d * d) * p / points
        a, b = min(max(a + slope.sum(), 0.001), 10.0), min(max(b + (2 * a * slope * log_x).sum(), 0.1), 2.0)
    return float(a), float(b)
