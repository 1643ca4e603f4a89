"""The encoder of parametric UMAP: linear layers with a leaky rectifier, in numpy with manual gradients."""

from __future__ import annotations

import io
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

SLOPE = 0.1
#: Pieces of a batch, whatever the machine: so many sums are added.
PIECES = 4
VERSION = 1


@dataclass
class TrainOptions:
    a: float = 1.5
    b: float = 0.9
    lr: float = 0.001
    n_epochs: int = 500
    batch: int = 256
    negatives: int = 5
    correlation: float = 0.0


@dataclass
class Mlp:
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def start(cls, sizes: list[int], seed: int = 42) -> Mlp:
        rng = np.random.default_rng(seed)
        bound = [1 / np.sqrt(a) for a in sizes[:-1]]
        return cls([rng.uniform(-u, u, (a, b)) for u, a, b in zip(bound, sizes, sizes[1:])], [rng.uniform(-u, u, b) for u, b in zip(bound, sizes[1:])])

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """Inputs of every layer, and the output."""
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w
            x += b
            if k + 1 < len(self.weights):
                np.maximum(x, SLOPE * x, out=x)
            out.append(x)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.layers(np.asarray(x, float))[-1]

    def gradients(self, layers: list[np.ndarray], g: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for k in range(len(self.weights) - 1, -1, -1):
            out.append((layers[k].T @ g, g.sum(0)))
            if k:
                g = g @ self.weights[k].T
                np.multiply(g, SLOPE, out=g, where=layers[k] <= 0)
        return out[::-1]

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, meta=json.dumps({"version": VERSION, "layers": len(self.weights)}), **{f"w{k}": w for k, w in enumerate(self.weights)}, **{f"b{k}": b for k, b in enumerate(self.biases)})
        return held.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Mlp:
        held = np.load(io.BytesIO(raw), allow_pickle=False)
        meta = json.loads(str(held["meta"]))
        if meta["version"] != VERSION:
            raise ValueError(f"model version {meta['version']} isn't {VERSION}")
        return cls([held[f"w{k}"] for k in range(meta["layers"])], [held[f"b{k}"] for k in range(meta["layers"])])


def umap_loss(s: np.ndarray, t: np.ndarray, target: np.ndarray, a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean cross-entropy of q = 1 / (1 + a (d2 + 1e-6)^b), q within 1e-7 of 0 and 1, and its gradients at both ends."""
    diff = s - t
    d2 = (diff * diff).sum(1) + 1e-6
    power = d2**b
    q = np.clip(1 / (1 + a * power), 1e-7, 1 - 1e-7)
    loss = -np.mean(target * np.log(q) + (1 - target) * np.log(1 - q))
    slope = (target - q) / (q * (1 - q)) * (q * q * a * b * power / d2) / len(s)
    g = (2 * slope)[:, None] * diff
    return float(loss), g, -g


def correlation_loss(x: np.ndarray, z: np.ndarray) -> tuple[float, np.ndarray]:
    """Less the Pearson correlation of two lists of distances, and its gradient by z."""
    x, z = x - x.mean(), z - z.mean()
    sx, sz = np.sqrt((x * x).sum() + 1e-8), np.sqrt((z * z).sum() + 1e-8)
    r = float((x * z).sum() / (sx * sz))
    return -r, -(x / (sx * sz) - r * z / (sz * sz))


def train(x: np.ndarray, i: np.ndarray, j: np.ndarray, hidden: list[int], n_dim: int, o: TrainOptions, seed: int = 42) -> Mlp:
    """Adam on mini-batches of edges (target 1) and uniform negatives (target 0). A batch's rows go through the layers in PIECES, by a thread each."""
    with ThreadPoolExecutor(PIECES) as pool:
        return _train(x, i, j, hidden, n_dim, o, seed, pool)


def _train(x: np.ndarray, i: np.ndarray, j: np.ndarray, hidden: list[int], n_dim: int, o: TrainOptions, seed: int, pool: ThreadPoolExecutor) -> Mlp:
    net = Mlp.start([x.shape[1], *hidden, n_dim], seed)
    rng = np.random.default_rng(seed)
    state = [[np.zeros_like(p) for p in pair] for pair in zip(net.weights, net.biases)]
    square = [[np.zeros_like(p) for p in pair] for pair in zip(net.weights, net.biases)]
    n, t = len(x), 0
    for _ in range(o.n_epochs):
        order = rng.permutation(len(i))
        for s in range(0, len(i), o.batch):
            at = order[s : s + o.batch]
            src, dst = i[at], j[at]
            more = np.repeat(src, o.negatives)
            other = rng.integers(0, max(n - 1, 1), len(more))
            other += other >= more
            # A source meets its target and all its negatives: it goes through the layers once, and gathers their gradients.
            m = len(src)
            inputs = x[np.concatenate([src, dst, np.minimum(other, n - 1)])]
            cuts = [slice(c * len(inputs) // PIECES, (c + 1) * len(inputs) // PIECES) for c in range(PIECES)]
            layers = list(pool.map(lambda at: net.layers(inputs[at]), cuts))
            last = np.concatenate([piece[-1] for piece in layers])
            target = np.concatenate([np.ones(m), np.zeros(len(more))])
            own, ends = np.concatenate([np.arange(m), np.repeat(np.arange(m), o.negatives)]), last[m:]
            starts = last[own]
            _, ga, gb = umap_loss(starts, ends, target, o.a, o.b)
            if o.correlation:
                diff = starts - ends
                d = np.sqrt((diff * diff).sum(1) + 1e-8)
                _, gd = correlation_loss(np.sqrt(((inputs[own] - inputs[m:]) ** 2).sum(1)), d)
                extra = o.correlation * (gd / d)[:, None] * diff
                ga, gb = ga + extra, gb - extra
            gathered = ga[:m] + ga[m:].reshape(m, o.negatives, ga.shape[1]).sum(1)
            t += 1
            both = np.concatenate([gathered, gb])
            for k, pieces in enumerate(zip(*pool.map(lambda piece: net.gradients(*piece), [(held, both[at]) for held, at in zip(layers, cuts)]))):
                for c, (p, g) in enumerate(zip((net.weights[k], net.biases[k]), (sum(piece[c] for piece in pieces) for c in range(2)))):
                    state[k][c] += 0.1 * (g - state[k][c])
                    square[k][c] += 0.001 * (g * g - square[k][c])
                    p -= o.lr * (state[k][c] / (1 - 0.9**t)) / (np.sqrt(square[k][c] / (1 - 0.999**t)) + 1e-8)
    return net
