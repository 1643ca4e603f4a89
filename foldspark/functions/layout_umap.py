"""UMAP layouts in one task: sequential descent, sequential Adam, and Adam on frozen positions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np

from ..errors import NoGraphEdges
from .hashing import draw_numpy

EPS = np.finfo(float).eps
CLIP, NEAR, SAFE = 4.0, 1e-8, 0.001
#: Pairs that are computed at once, so that what they need stays in a core's cache; and threads that compute some each.
AT_ONCE, MOST_THREADS = 1 << 15, 4


@dataclass
class UmapOptions:
    a: float = 1.5
    b: float = 0.9
    lr: float = 1.0
    gamma: float = 1.0
    n_epochs: int = 500
    negatives: int = 5
    beta1: float = 0.5
    beta2: float = 0.9
    eps: float = 1e-7


@dataclass
class Density:
    """Standardised log radii in the data, half the sum of weights, and how hard radii are to be kept."""

    r: np.ndarray
    mu_total: float
    weight: float = 2.0
    share: float = 0.3
    shift: float = 0.1

    def active(self, epoch: int, n_epochs: int) -> bool:
        return self.weight > 0 and (epoch + 1) / n_epochs > 1 - self.share


def correlation(re: np.ndarray, r: np.ndarray, shift: float) -> tuple[float, float, float]:
    n = max(len(re) - 1, 1)
    off = re - re.mean()
    return float(re.mean()), float(np.sqrt((off * off).sum() / n + shift)), float((off * r).sum() / n)


@contextmanager
def _in_chunks() -> Iterator[Callable]:
    """run(n, work): work(s, e) for pieces s .. e of 0 .. n, some at once; each writes places of its own, so threads don't change a result."""
    with ThreadPoolExecutor(max(1, min(MOST_THREADS, os.cpu_count() or 1))) as pool:
        yield lambda n, work: [x.result() for x in [pool.submit(work, s, min(s + AT_ONCE, n)) for s in range(0, n, AT_ONCE)]]


def _squares(deltas: list[np.ndarray]) -> np.ndarray:
    """Sums of squares over dimensions, from the first on."""
    out = deltas[0] * deltas[0]
    for delta in deltas[1:]:
        out += delta * delta
    return out


def kernel(x: list[np.ndarray], i: np.ndarray, j: np.ndarray, o: UmapOptions) -> tuple[np.ndarray, np.ndarray]:
    """1 / (1 + a d^2b) of edges, and that times d^2; ``x`` is a list of columns."""
    d2 = _squares([c[i] - c[j] for c in x])
    phi = 1 / (1 + o.a * d2**o.b)
    return phi, phi * d2


class DensityTerm:
    """What the radii in the embedding ask of every edge, at one set of positions: from each node's sums of the kernel and of the kernel times d2."""

    def __init__(self, phi_sum: np.ndarray, far_sum: np.ndarray, d: Density):
        n = len(phi_sum)
        self.phi_sum = phi_sum
        re = np.log(1e-8 + far_sum / np.maximum(self.phi_sum, EPS))
        mean, std, cov = correlation(re, d.r, d.shift)
        self.weight = d.r - cov * (re - mean) / (std * std)
        self.scale = d.weight * d.mu_total / (std * max(n - 1, 1))
        self.inv = np.exp(-re)

    @classmethod
    def of(cls, x: list[np.ndarray], i: np.ndarray, j: np.ndarray, o: UmapOptions, d: Density, run: Callable | None = None) -> DensityTerm:
        n, phi, far = len(x[0]), np.empty(len(i)), np.empty(len(i))

        def radii(s: int, e: int) -> None:
            phi[s:e], far[s:e] = kernel(x, i[s:e], j[s:e], o)

        run(len(i), radii) if run else radii(0, len(i))
        return cls(np.bincount(i, phi, n), np.bincount(i, far, n), d)

    def edge(self, i, j, w, d2, o: UmapOptions):
        power = d2**o.b
        phi = 1 / (1 + o.a * power)
        slope = o.a * o.b * power / d2 * phi
        common = 1 - o.b * (1 - phi)
        own, other = (phi / np.maximum(self.phi_sum[k], EPS) * (common * self.inv[k] + slope) for k in (i, j))
        return self.scale * (self.weight[i] * own + self.weight[j] * other) / np.maximum(w, EPS)


def attraction(x: list[np.ndarray], p: np.ndarray, q: np.ndarray, w: np.ndarray, o: UmapOptions, term: DensityTerm | None) -> list[np.ndarray]:
    """What each edge adds to the step of p, and takes off that of q, a column a dimension."""
    deltas = [c[p] - c[q] for c in x]
    d2 = _squares(deltas)
    ok = d2 >= NEAR
    safe = np.where(ok, d2, 1.0)
    power = safe**o.b
    pull = np.where(ok, 2 * (2 * o.a * o.b) * power / (safe * (1 + o.a * power)), 0.0)
    steps = [-pull * delta for delta in deltas]
    if term is not None:
        two = np.where(ok, 2 * term.edge(p, q, w, safe, o), 0.0)
        for step, delta in zip(steps, deltas):
            step += 2 * np.clip(two * delta, -CLIP, CLIP)
    return steps


def repulsion(x: list[np.ndarray], i: np.ndarray, k: np.ndarray, o: UmapOptions) -> list[np.ndarray]:
    """What each negative k adds to the step of i. A node that draws itself is at distance 0, and pushes by 0."""
    deltas = [c[i] - c[k] for c in x]
    far = _squares(deltas) + SAFE
    push = np.clip(2 * o.gamma * o.b / (far * (1 + o.a * far**o.b)), -CLIP, CLIP)
    return [push * delta for delta in deltas]


def adam_step(x: list[np.ndarray], m: list[np.ndarray], v: list[np.ndarray], g: list[np.ndarray], moved: np.ndarray, epoch: int, o: UmapOptions) -> None:
    """One step of the nodes that had an edge; positions and moments are changed in place."""
    t = epoch + 1
    root = np.sqrt(1 - o.beta2**t)
    rate = o.lr * (1 - epoch / o.n_epochs) * root / (1 - o.beta1**t)
    for c in range(len(x)):
        m[c] += np.where(moved, (1 - o.beta1) * (g[c] - m[c]), 0.0)
        v[c] += np.where(moved, (1 - o.beta2) * (g[c] ** 2 - v[c]), 0.0)
        x[c] += np.where(moved, rate * m[c] / (np.sqrt(v[c]) + root * o.eps), 0.0)


def periods(w: np.ndarray) -> np.ndarray:
    """Epochs between two samples of an edge."""
    share = w / w.max()
    return np.where(share > 0, 1 / np.where(share > 0, share, 1), 1e8)


def adam_parallel(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, o: UmapOptions, seed: int = 42, density: Density | None = None, both_ends: bool = False) -> np.ndarray:
    """All gradients of an epoch at frozen positions, then one Adam step of the nodes that had an edge.

    Edges i < j are read; attraction acts on both ends and is doubled. Negatives
    are hashed draws: of the smaller end as its schedule asks, or, with
    ``both_ends``, a fixed number at either end.
    """
    once = i < j
    a, b, wt = i[once], j[once], w[once]
    if not len(a):
        raise NoGraphEdges("no edge joins two nodes")
    order = np.lexsort((b, a))
    a, b, wt = a[order], b[order], wt[order]
    number = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    n = len(x)
    # A column for each dimension: places are gathered from one short array each.
    x = [np.array(column, float) for column in x.T]
    period = periods(wt)
    later, later_neg, period_neg = period.copy(), period / o.negatives, period / o.negatives
    m, v = [np.zeros(n) for _ in x], [np.zeros(n) for _ in x]
    with _in_chunks() as run:
        for epoch in range(o.n_epochs):
            at = np.flatnonzero(later <= epoch)
            if not len(at):
                continue
            term = DensityTerm.of(x, i, j, o, density, run) if density is not None and density.active(epoch, o.n_epochs) else None
            p, q = a[at], b[at]
            steps = [np.empty(len(at)) for _ in x]

            def attract(s: int, e: int) -> None:
                for step, found in zip(steps, attraction(x, p[s:e], q[s:e], wt[at[s:e]], o, term)):
                    step[s:e] = found

            run(len(at), attract)
            g = [np.bincount(p, step, n) - np.bincount(q, step, n) for step in steps]
            if both_ends:
                times = np.full(2 * len(at), o.negatives)
                node, tag = np.concatenate([p, q]), np.concatenate([number[at], number[at] + (1 << 20)])
            else:
                times = np.maximum(np.floor((epoch - later_neg[at]) / period_neg[at]), 0).astype(int)
                node, tag = p, number[at]
            # Draws of an edge follow each other; a piece of all draws is one of these edges, cut at both sides.
            ends = np.cumsum(times)
            pushes = [np.empty(ends[-1]) for _ in x]
            who = np.repeat(node, times)

            def repel(s: int, e: int) -> None:
                first, last = np.searchsorted(ends, s, side="right"), np.searchsorted(ends, e - 1, side="right") + 1
                starts = ends[first:last] - times[first:last]
                many = np.minimum(ends[first:last], e) - np.maximum(starts, s)
                draw = np.arange(s, e) - np.repeat(starts, many)
                k = draw_numpy(seed, who[s:e], epoch, np.repeat(tag[first:last], many), draw, n)
                for c, push in zip(pushes, repulsion(x, who[s:e], k, o)):
                    c[s:e] = push

            run(len(who), repel)
            moved = np.zeros(n, bool)
            moved[p] = moved[q] = True
            for c, push in enumerate(pushes):
                g[c] += np.bincount(who, push, n)
            adam_step(x, m, v, g, moved, epoch, o)
            later[at] += period[at]
            if not both_ends:
                later_neg[at] += times * period_neg[at]
    return np.stack(x, axis=1)


def sequential(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, o: UmapOptions, seed: int = 42, density: Density | None = None, adam: bool = False) -> np.ndarray:
    """Edge after edge, each seeing the moves before it: plain descent, or Adam with moments touched by every edge.

    The order matters, so this is one loop in one task; it is for small graphs.
    """
    order = np.lexsort((j, i))
    i, j, w = i[order], j[order], w[order]
    if not len(i):
        raise NoGraphEdges("no edge joins two nodes")
    n, dims = x.shape
    # A list for each dimension: an epoch's draws are made at once, and what is left to the loop is plain numbers.
    x = [column.tolist() for column in x.T.astype(float)]
    m, v = [[0.0] * n for _ in x], [[0.0] * n for _ in x]
    period = periods(w)
    later, later_neg, period_neg = period.copy(), period / o.negatives, period / o.negatives
    number = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    beta1, beta2, b, ab, push_by = 1 - o.beta1, 1 - o.beta2, o.b, 2 * o.a * o.b, 2 * o.gamma * o.b
    axes = list(zip(x, m, v))
    for epoch in range(o.n_epochs):
        lr, t = o.lr * (1 - epoch / o.n_epochs), epoch + 1
        root = (1 - o.beta2**t) ** 0.5
        rate, tiny = lr * root / (1 - o.beta1**t), root * o.eps
        term = DensityTerm.of([np.array(c) for c in x], i, j, o, density) if density is not None and density.active(epoch, o.n_epochs) else None
        at = np.flatnonzero(later <= epoch)
        times = np.maximum(np.floor((epoch - later_neg[at]) / period_neg[at]), 0).astype(int)
        ends = np.cumsum(times)
        place = np.arange(ends[-1] if len(at) else 0) - np.repeat(ends - times, times)
        drawn = draw_numpy(seed, np.repeat(i[at], times), epoch, np.repeat(number[at], times), place, n).tolist()
        first = 0
        for e, p, q, last in zip(at.tolist(), i[at].tolist(), j[at].tolist(), ends.tolist()):
            deltas = [c[q] - c[p] for c in x]
            d2 = 0.0
            for delta in deltas:
                d2 += delta * delta
            if d2 >= NEAR:
                power = d2**b
                pull = ab * power / (d2 * (1 + o.a * power))
                two = 2 * float(term.edge(p, q, w[e], d2, o)) if term is not None else 0.0
                for (c, cm, cv), delta in zip(axes, deltas):
                    g = pull * delta
                    if not adam:
                        g = CLIP if g > CLIP else -CLIP if g < -CLIP else g
                    if term is not None:
                        g += min(max(-two * delta, -CLIP), CLIP)
                    if adam:
                        square = g * g
                        cv[p] = u = cv[p] + beta2 * (square - cv[p])
                        cm[p] = s = cm[p] + beta1 * (g - cm[p])
                        c[p] += rate * s / (u**0.5 + tiny)
                        cv[q] = u = cv[q] + beta2 * (square - cv[q])
                        cm[q] = s = cm[q] + beta1 * (-g - cm[q])
                        c[q] += rate * s / (u**0.5 + tiny)
                    else:
                        c[p] += g * lr
                        c[q] += -g * lr
            for k in drawn[first:last]:
                if k == p:
                    continue
                deltas = [c[p] - c[k] for c in x]
                far = 0.0
                for delta in deltas:
                    far += delta * delta
                far += SAFE
                push = push_by / (far * (1 + o.a * far**b))
                push = CLIP if push > CLIP else -CLIP if push < -CLIP else push
                for (c, cm, cv), delta in zip(axes, deltas):
                    g = push * delta
                    if adam:
                        cv[p] = u = cv[p] + beta2 * (g * g - cv[p])
                        cm[p] = s = cm[p] + beta1 * (g - cm[p])
                        c[p] += rate * s / (u**0.5 + tiny)
                    else:
                        c[p] += g * lr
            first = last
        later[at] += period[at]
        later_neg[at] += times * period_neg[at]
    return np.array(x).T
