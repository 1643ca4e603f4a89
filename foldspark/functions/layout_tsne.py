"""t-SNE layouts in two dimensions: exact, Barnes-Hut and FFT-interpolated repulsion, and one descent for all.

A repulsion gives, for every point, the sum of q^2 (y_i - y_j) and the sum of
q over the others, q = 1 / (1 + d^2).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..errors import UnknownOption, WrongDimensions
from .layout_umap import EPS, Density, correlation

Repulsion = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
MOST_BOXES = 140
DEPTH = 24


@dataclass
class TsneOptions:
    n_epochs: int = 1000
    lr: float | None = None
    early_exaggeration: float = 12.0
    early_epochs: int = 250
    late_exaggeration: float = 1.0
    theta: float = 0.5
    interpolation_points: int = 3
    momentum: tuple[float, float, int] = (0.5, 0.8, 250)

    def rate(self, n: int) -> float:
        return self.lr if self.lr is not None else max(n / 12.0, 200.0)


def exact_repulsion(y: np.ndarray, own: slice = slice(None), at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all others of the points ``own``, some rows of pairs at once."""
    first, last, _ = own.indices(len(y))
    force, total = np.empty((last - first, 2)), np.empty(last - first)
    rows = max(1, at_once // max(len(y), 1))
    for s in range(first, last, rows):
        diff = y[s : min(s + rows, last), None] - y[None]
        q = 1 / (1 + (diff * diff).sum(2))
        q[np.arange(len(q)), np.arange(s, s + len(q))] = 0
        force[s - first : s - first + len(q)] = ((q * q)[:, :, None] * diff).sum(1)
        total[s - first : s - first + len(q)] = q.sum(1)
    return force, total


def _spread_bits(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def morton(y: np.ndarray, low: np.ndarray, side: float, depth: int = DEPTH) -> np.ndarray:
    """Interleaved bits of the cell of each point in a grid of 2 ** depth by 2 ** depth."""
    cell = np.clip(((y - low) / side * (1 << depth)).astype(np.int64), 0, (1 << depth) - 1)
    return _spread_bits(cell[:, 0]) | (_spread_bits(cell[:, 1]) << np.uint64(1))


def tree_repulsion(y: np.ndarray, theta: float = 0.5, own: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Barnes-Hut: a cell that looks small enough from a point stands for its points.

    The tree is a list of levels, each the sorted Morton codes of its cells, and
    is walked for many of the points ``own`` at once: a frontier of (point, cell)
    either counts or is opened into the cells below. theta 0 opens everything.
    """
    n = len(y)
    low = y.min(0)
    side = float((y.max(0) - low).max()) * (1 + 1e-9) or 1.0
    code = morton(y, low, side)
    levels = []
    order = np.argsort(code, kind="stable")
    sorted_code, sorted_y = code[order], y[order]
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(sorted_y, axis=0)])
    for depth in range(DEPTH + 1):
        of = sorted_code >> np.uint64(2 * (DEPTH - depth))
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        last = np.append(first[1:], n)
        levels.append((of[first], last - first, (sums[last] - sums[first]) / (last - first)[:, None]))
        if len(first) == n:
            break
    return walk(y[own], code[own], levels, side, theta)


#: Points that walk the tree at once, so that a level's frontier stays in a core's cache.
WALKED = 1024


def walk(y: np.ndarray, code: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], side: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of points y with Morton codes over a tree, or the part of one that they look at.

    A level holds its cells' codes in order, counts and centres; the first is the
    root's. A cell of one point, or of the last level of all, is never opened.
    Points go together with those near them, whose cells they share.
    """
    force, total = np.zeros((len(y), 2)), np.zeros(len(y))
    below = []  # of each cell, the first of the next level's and the one after the last
    for (codes, _, _), (under, _, _) in zip(levels, levels[1:]):
        start = codes << np.uint64(2)
        below.append((np.searchsorted(under, start), np.searchsorted(under, start + np.uint64(4))))
    flat = [(codes, counts, np.ascontiguousarray(centres[:, 0]), np.ascontiguousarray(centres[:, 1])) for codes, counts, centres in levels]
    order = np.argsort(code, kind="stable")
    for s in range(0, len(y), WALKED):
        at = order[s : s + WALKED]
        force[at, 0], force[at, 1], total[at] = _walk(np.ascontiguousarray(y[at, 0]), np.ascontiguousarray(y[at, 1]), code[at], flat, below, side, theta)
    return force, total


def _walk(px: np.ndarray, py: np.ndarray, code: np.ndarray, levels: list[tuple], below: list[tuple], side: float, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(px)
    fx, fy, total = np.zeros(n), np.zeros(n), np.zeros(n)
    point, cell = np.arange(n), np.zeros(n, np.int64)
    for depth, (codes, counts, cx, cy) in enumerate(levels):
        dx, dy = px[point] - cx[cell], py[point] - cy[cell]
        d2 = dx * dx + dy * dy
        own = (code >> np.uint64(2 * (DEPTH - depth)))[point] == codes[cell]
        many = counts[cell]
        bottom = depth + 1 == len(levels)
        width = side / (1 << depth)
        far = (~own & (width * width < theta * theta * d2)) | (many == 1) | bottom
        took = np.flatnonzero(far)
        who, d2 = point[took], 1 + d2[took]
        q = (many[took] - own[took]) / d2
        total += np.bincount(who, q, n)
        q /= d2
        fx += np.bincount(who, q * dx[took], n)
        fy += np.bincount(who, q * dy[took], n)
        if len(took) == len(far):
            break
        rest = np.flatnonzero(~far)
        point, cell = point[rest], cell[rest]
        lo, hi = below[depth]
        lo, each = lo[cell], hi[cell] - lo[cell]
        ends = np.cumsum(each)
        cell = np.repeat(lo - ends + each, each) + np.arange(ends[-1])
        point = np.repeat(point, each)
    return fx, fy, total


#: Points whose charges are spread at once.
SPREAD = 1 << 17


def _fast_size(n: int) -> int:
    """The next size with no prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


@dataclass
class Grid:
    """Boxes over the layout, each with nodes by nodes interpolation points; bounded, however many points there are."""

    low: np.ndarray
    span: float
    nodes: int = 3
    least_boxes: int = 50
    most_boxes: int = MOST_BOXES

    def __post_init__(self):
        self.boxes = int(min(max(np.ceil(self.span), self.least_boxes), self.most_boxes))
        self.h = self.span * (1 + 1e-9) / self.boxes
        self.size = self.boxes * self.nodes

    def _at(self, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(grid point, weight) of each of a point's nodes, by Lagrange's polynomials."""
        nodes = self.nodes
        place = (y - self.low) / self.h
        box = np.clip(place.astype(int), 0, self.boxes - 1)
        t = (np.arange(nodes) + 0.5) / nodes
        weights = np.ones((len(y), 2, nodes))
        for k in range(nodes):
            for m in range(nodes):
                if m != k:
                    weights[:, :, k] *= (place - box - t[m]) / (t[k] - t[m])
        return [((box[:, 0] * nodes + a) * self.size + box[:, 1] * nodes + b, weights[:, 0, a] * weights[:, 1, b]) for a in range(nodes) for b in range(nodes)]

    def spread(self, y: np.ndarray) -> np.ndarray:
        """Four charges, 1, x, y and x^2 + y^2, summed over the grid, some points at once; sums over parts of the points add up."""
        held = np.zeros((4, self.size * self.size))
        for s in range(0, len(y), SPREAD):
            part = y[s : s + SPREAD]
            charges = np.stack([np.ones(len(part)), part[:, 0], part[:, 1], (part * part).sum(1)])
            for k, w in self._at(part):
                for out, c in zip(held, charges):
                    out += np.bincount(k, w * c, len(out))
        return held

    def felt(self, held: np.ndarray) -> np.ndarray:
        """The charges convolved with 1 / (1 + d^2)^2 by FFT."""
        size, grid = self.size, _fast_size(2 * self.size)
        gap = np.arange(grid)
        gap = np.where(gap < size, gap, gap - grid) * (self.h / self.nodes)
        near = np.abs(gap) < size * self.h / self.nodes + self.h
        spectrum = np.fft.rfft2(np.where(near[:, None] & near[None], 1 / (1 + gap[:, None] ** 2 + gap[None] ** 2) ** 2, 0.0))
        return np.stack([np.fft.irfft2(np.fft.rfft2(c.reshape(size, size), (grid, grid)) * spectrum, (grid, grid))[:size, :size].ravel() for c in held])

    def gather(self, y: np.ndarray, felt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sums of every point, from what its nodes felt."""
        one, x1, x2, sq = (sum(w * c[k] for k, w in self._at(y)) for c in felt)
        total = (1 + (y * y).sum(1)) * one - 2 * (y[:, 0] * x1 + y[:, 1] * x2) + sq - 1
        return np.stack([y[:, 0] * one - x1, y[:, 1] * one - x2], 1), total


def fft_repulsion(y: np.ndarray, nodes: int = 3, own: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Linderman et al. (2019): charges go to a grid by Lagrange weights, are convolved by FFT, and come back to the points ``own``."""
    low, high = y.min(0), y.max(0)
    grid = Grid(low, float((high - low).max()) or 1.0, nodes)
    return grid.gather(y[own], grid.felt(grid.spread(y)))


def repulsion_of(method: str, o: TsneOptions) -> Repulsion:
    """The sums of all points, or of those of a slice, which is a second argument."""
    name = method.lower().replace("_", " ")
    if name in ("barnes hut", "bh"):
        return exact_repulsion if o.theta == 0 else lambda y, own=slice(None): tree_repulsion(y, o.theta, own)
    if name == "fft":
        return lambda y, own=slice(None): fft_repulsion(y, o.interpolation_points, own)
    if name == "exact":
        return exact_repulsion
    raise UnknownOption(f"no t-SNE method {method!r}; there are barnes_hut, fft and exact")


def attraction(y: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Sums of p q (y_i - y_j) of n nodes; ``own`` numbers the nodes i from 0 on."""
    diff = y[i] - y[j]
    pull = (p / (1 + (diff * diff).sum(1)))[:, None] * diff
    return np.stack([np.bincount(own, pull[:, c], n) for c in range(2)], 1)


def radii_sums(y: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Sums of the kernel and of the kernel times d2 over the edges of n nodes: columns of an array."""
    diff = y[i] - y[j]
    d2 = (diff * diff).sum(1)
    phi = 1 / (1 + d2)
    return np.stack([np.bincount(own, phi, n), np.bincount(own, phi * d2, n)], 1)


def density_shares(sums: np.ndarray, d: Density) -> np.ndarray:
    """What each node's radius in the embedding asks of its edges, from the ``radii_sums`` of all."""
    phi_sum = np.maximum(sums[:, 0], EPS)
    re = np.log(1e-8 + sums[:, 1] / phi_sum)
    mean, std, cov = correlation(re, d.r, d.shift)
    weight = d.r / std - cov / std**3 * (re - mean)
    return weight * (1 + np.exp(-re)) / phi_sum * (d.weight / max(len(re) - 1, 1))


def density_pull(y: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """The density term's gradient of n nodes."""
    diff = y[i] - y[j]
    phi = 1 / (1 + (diff * diff).sum(1))
    g = (phi * phi * (share[i] + share[j]))[:, None] * diff
    return np.stack([np.bincount(own, g[:, c], n) for c in range(2)], 1)


def optimise(y: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray, o: TsneOptions, method: str = "fft", density: Density | None = None) -> np.ndarray:
    """The descent of edges that one task holds."""
    repel = repulsion_of(method, o)

    def forces(y: np.ndarray, exaggeration: float, active: bool) -> tuple:
        n = len(y)
        less = density_pull(y, i, i, j, density_shares(radii_sums(y, i, i, j, n), density), n) if active else None
        return *repel(y), attraction(y, i, i, j, p * exaggeration, n), less

    return descend(y, o, forces, density)


def descend(y: np.ndarray, o: TsneOptions, forces: Callable, density: Density | None = None) -> np.ndarray:
    """Descent with momentum and gains; steps are capped and the layout is centred every epoch.

    ``forces`` gives, of positions, the exaggeration and whether the density term
    is asked for: repulsion, sums of q, attraction, and the term or None.
    """
    if y.shape[1] != 2:
        raise WrongDimensions("t-SNE layouts have two dimensions")
    y = y.astype(float).copy()
    lr = o.rate(len(y))
    cap = max(0.025 * lr, 5.0)
    step, gain = np.zeros_like(y), np.ones_like(y)
    for epoch in range(o.n_epochs):
        push, q, pull, less = forces(y, o.early_exaggeration if epoch < o.early_epochs else o.late_exaggeration, density is not None and density.active(epoch, o.n_epochs))
        z = float(q.sum())
        g = pull - push * (1 / z if z > 1e-12 else 0.0)
        if less is not None:
            g -= less
        gain = np.maximum(np.where((g > 0) != (step > 0), gain + 0.2, gain * 0.8), 0.01)
        step = (o.momentum[0] if epoch < o.momentum[2] else o.momentum[1]) * step - lr * gain * g
        size = np.sqrt((step * step).sum(1, keepdims=True))
        step = np.where(size > cap, step * (cap / np.maximum(size, 1e-300)), step)
        y += step
        y -= y.mean(0)
    return y
