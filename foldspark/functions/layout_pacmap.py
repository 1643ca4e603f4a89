"""PaCMAP layout: full-batch Adam over three kinds of pairs and three phases."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..operators.epochs import phase_weights


#: Near, mid-near and further pairs: the constant beside their squared distance.
CONSTANTS = (10.0, 10000.0, 1.0)


def pulls(x: np.ndarray, i: np.ndarray, j: np.ndarray, kind: int, weight: float) -> np.ndarray:
    """What each pair of a kind adds to the step of i, and takes off that of j."""
    c = CONSTANTS[kind]
    diff = x[i] - x[j]
    return (-2 * c * (-weight if kind == 2 else weight) / (c + 1 + (diff * diff).sum(1)) ** 2)[:, None] * diff


def gradient(x: np.ndarray, pairs: dict[str, tuple[np.ndarray, np.ndarray]], weights: tuple[float, float, float]) -> np.ndarray:
    """The direction of the step: near and mid-near pairs draw together, further pairs apart."""
    out = np.zeros_like(x)
    for kind, (name, weight) in enumerate(zip(("near", "mid_near", "further"), weights)):
        i, j = pairs[name]
        if not len(i) or not weight:
            continue
        g = pulls(x, i, j, kind, weight)
        for k in range(x.shape[1]):
            out[:, k] += np.bincount(i, g[:, k], len(x)) - np.bincount(j, g[:, k], len(x))
    return out


def descend(x: np.ndarray, direction: Callable, n_epochs: int = 450, lr: float = 0.01, first: int = 100, second: int = 200, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-7) -> np.ndarray:
    """Adam along ``direction`` of positions and weights."""
    x = x.astype(float).copy()
    m, v = np.zeros_like(x), np.zeros_like(x)
    for epoch in range(n_epochs):
        g = direction(x, phase_weights(epoch, first, second))
        root = np.sqrt(1 - beta2 ** (epoch + 1))
        m += (1 - beta1) * (g - m)
        v += (1 - beta2) * (g * g - v)
        x += lr * root / (1 - beta1 ** (epoch + 1)) * m / (np.sqrt(v) + root * eps)
    return x


def optimise(x: np.ndarray, pairs: dict[str, tuple[np.ndarray, np.ndarray]], n_epochs: int = 450, lr: float = 0.01, first: int = 100, second: int = 200) -> np.ndarray:
    """The descent of pairs that one task holds."""
    return descend(x, lambda x, weights: gradient(x, pairs, weights), n_epochs, lr, first, second)
