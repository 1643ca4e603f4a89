"""Dense linear algebra of bounded size, in numpy. Signs are fixed everywhere: the entry of largest size is positive."""

from __future__ import annotations

import numpy as np

DENSE_ENTROPY = 5000
SKETCH_RANK = 100


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their entry of largest size (the first of equals) is positive."""
    if not vectors.size:
        return vectors
    top = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def randomised_svd(x: np.ndarray, rank: int, seed: int = 42, oversample: int | None = None, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, s, v) of rank ``rank`` from a Gaussian sketch with power iterations (Halko, Martinsson and Tropp, 2011). x needs shape, @ and .T."""
    oversample = oversample if oversample is not None else (rank if rank < 10 else 10)
    size = min(rank + oversample, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((x.shape[1], size)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    u, s, vt = np.linalg.svd((x.T @ q).T, full_matrices=False)
    u, v = q @ u, vt.T
    turn = np.sign(fix_signs(u)[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])]) * np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])])
    return (u * turn)[:, :rank], s[:rank], (v * turn)[:, :rank]


class Sparse:
    """A square sparse matrix from (i, j, w) over 0 .. n - 1, with products only."""

    def __init__(self, i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int):
        order = np.lexsort((j, i))
        self.i, self.j, self.w, self.shape = i[order], j[order], w[order], (n, n)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if x.ndim == 1:
            return np.bincount(self.i, weights=self.w * x[self.j], minlength=self.shape[0])
        return np.stack([self @ x[:, c] for c in range(x.shape[1])], axis=1)

    @property
    def T(self) -> Sparse:
        return Sparse(self.j, self.i, self.w, self.shape[0])

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        np.add.at(out, (self.i, self.j), self.w)
        return out


def lanczos(times, n: int, k: int, largest: bool = True, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of up to k extreme eigenpairs of a symmetric operator, given by its product ``times``.

    min(4 k + 30, n) steps with full reorthogonalisation; an early end of the
    Krylov space gives fewer pairs.
    """
    steps = min(4 * k + 30, n)
    q = np.random.default_rng(seed).standard_normal(n)
    q /= np.linalg.norm(q)
    basis, alpha, beta = np.empty((steps, n)), [], []
    basis[0] = q
    for s in range(steps):
        v = times(basis[s])
        alpha.append(float(basis[s] @ v))
        v = v - alpha[s] * basis[s] - (beta[s - 1] * basis[s - 1] if s else 0)
        held = basis[: s + 1]
        for _ in range(2):
            v = v - held.T @ (held @ v)
        b = float(np.linalg.norm(v))
        if s + 1 == steps or b < 1e-12:
            break
        beta.append(b)
        basis[s + 1] = v / b
    m = len(alpha)
    values, small = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
    order = np.argsort(-values if largest else values, kind="stable")[:k]
    return values[order], fix_signs(basis[:m].T @ small[:, order])


def symmetric_eigen(matrix, k: int, largest: bool = True, seed: int = 42, dense_up_to: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The k extreme eigenpairs of a Sparse or dense symmetric matrix."""
    n = matrix.shape[0]
    if n <= dense_up_to:
        values, vectors = np.linalg.eigh(matrix.dense() if isinstance(matrix, Sparse) else matrix)
        order = np.argsort(-values if largest else values, kind="stable")[:k]
        return values[order], fix_signs(vectors[:, order])
    return lanczos(lambda x: matrix @ x, n, k, largest, seed)


def singular_values(matrix, seed: int = 42) -> np.ndarray:
    n = matrix.shape[0]
    if n < DENSE_ENTROPY:
        return np.linalg.svd(matrix.dense() if isinstance(matrix, Sparse) else matrix, compute_uv=False)
    sketch = np.linalg.qr(matrix @ np.random.default_rng(seed).standard_normal((n, SKETCH_RANK + 10)))[0]
    return np.linalg.svd((matrix.T @ sketch).T, compute_uv=False)[:SKETCH_RANK]


def entropy_curve(s: np.ndarray, t_max: int) -> np.ndarray:
    """Von Neumann entropy of powers 1 .. t_max: that of s^t over its sum."""
    eps = np.finfo(float).eps
    out, now = [], np.ones_like(s)
    for _ in range(t_max):
        now = now * s
        p = now / max(now.sum(), eps)
        out.append(-float(np.sum(p * np.log(p + eps))))
    return np.array(out)


def knee(y: np.ndarray) -> int:
    """The breakpoint (index, not power) with the least absolute error of two fitted lines.

    The line before breakpoint c is fitted to points 0 .. c; the line after it
    to points c - 1 .. n - 1. Both errors count the breakpoint itself.
    """
    n = len(y)
    if n < 3:
        raise ValueError("a knee needs at least three points")
    x = np.arange(n, dtype=float)

    def line(a: int, b: int) -> np.ndarray:
        xs, ys = x[a:b], y[a:b]
        m = len(xs)
        det = m * (xs * xs).sum() - xs.sum() ** 2
        slope = (m * (xs * ys).sum() - xs.sum() * ys.sum()) / det
        return slope * x + ((xs * xs).sum() * ys.sum() - xs.sum() * (xs * ys).sum()) / det

    errors = [np.abs(line(0, c + 1)[: c + 1] - y[: c + 1]).sum() + np.abs(line(c - 1, n)[c:] - y[c:]).sum() for c in range(1, n - 1)]
    return 1 + int(np.argmin(errors))


def classic_mds(d: np.ndarray, k: int, randomised: bool = True, seed: int = 42) -> np.ndarray:
    """u sqrt(s) of the doubly centred squared distances."""
    sq = d * d
    b = -0.5 * (sq - sq.mean(0) - sq.mean(1)[:, None] + sq.mean())
    if randomised and min(b.shape) > 4 * k:
        u, s, _ = randomised_svd(b, k, seed)
    else:
        u, s, _ = np.linalg.svd(b)
        u = fix_signs(u)
    return u[:, :k] * np.sqrt(s[:k])


def sgd_mds(d: np.ndarray, k: int, start: np.ndarray | None = None, seed: int = 42, n_iter: int = 800, lr: float = 0.001) -> np.ndarray:
    """Stress descent on random pairs, 2 n ln n each round, with a falling rate; ends when stress hardly changes."""
    n = len(d)
    if n < 2:
        return np.zeros((n, k))
    rng = np.random.default_rng(seed)
    x = classic_mds(d, k, seed=seed) if start is None else start.copy()
    spread = np.sqrt(np.mean(x * x)) or 1.0
    x = x / spread
    far = d / spread
    n_pairs = max(1, int(2 * n * np.log(n)))
    before = np.inf
    for r in range(n_iter):
        step = lr * np.exp(-5.0 * r / n_iter)
        i, j = rng.integers(0, n, n_pairs), rng.integers(0, n, n_pairs)
        i, j = i[i != j], j[i != j]
        diff = x[i] - x[j]
        now = np.sqrt((diff * diff).sum(1)) + 1e-12
        off = now - far[i, j]
        push = (step * 2 * off / now)[:, None] * diff
        for c in range(k):
            x[:, c] += np.bincount(j, push[:, c], n) - np.bincount(i, push[:, c], n)
        stress = float(np.mean(off * off))
        if r > 50 and abs(before - stress) < 1e-6 * max(before, 1e-300):
            break
        before = stress
    return x * spread


def pca(x: np.ndarray, k: int, randomised: bool = False, seed: int = 42) -> np.ndarray:
    """Scores on the first k principal axes."""
    centred = x - x.mean(0)
    if randomised and min(x.shape) > 4 * k:
        u, s, _ = randomised_svd(centred, k, seed)
        return u * s
    values, axes = np.linalg.eigh(centred.T @ centred)
    return centred @ fix_signs(axes[:, np.argsort(-values, kind="stable")[:k]])
