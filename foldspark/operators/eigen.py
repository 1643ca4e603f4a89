"""Extreme eigenpairs of a symmetric matrix that is an edge table: restarted block Krylov subspaces.

Nodes are dealt into blocks of rows by a hash of the id, and edges into tiles by the
blocks of their ends, once. A step multiplies the matrix with a block of a few columns:
every block of rows sends each other the rows that its tile needs, and adds up the tiles'
products as they pass; the result is written. A cycle takes some steps from a
block V by the recurrence of Chebyshev polynomials, T_q+1 V = 2 A T_q V - T_q-1 V,
with A scaled by a bound on its norm. Then a Rayleigh-Ritz step over all of them
picks the best vectors of the whole subspace, which start the next cycle, until
the residuals of those asked for are small.

Inner products of that subspace need no table of all its columns: as the matrix is
symmetric, <T_a V, T_b V> is half of <V, T_a+b V> + <V, T_|a-b| V>, and those
moments come from neighbouring steps. Only they, a block squared for each step,
reach the driver; Ritz vectors are sums over the written steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import normals
from ..materialize import discard, materialize

#: Steps of a cycle.
STEPS = 9
#: Ritz vectors beyond those asked for, which speed up the others.
MORE = 10
#: Directions that are this much weaker than the strongest are numerical noise.
NOISE = 1e-10
#: Rows of a block: as many at least, unless there are fewer in all or more than a core's share, and at most.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 16


@dataclass
class Eigenpairs:
    """``values`` in order, the table ``vectors`` (id, v array<double>, one entry for each value), ``residuals`` |A v - value v|, and the cycles taken."""

    values: np.ndarray
    vectors: DataFrame
    residuals: np.ndarray
    cycles: int


def multiply_columns(edges: DataFrame, columns: DataFrame, names: list[str]) -> DataFrame:
    """(id, names): the matrix times each column, as a join; nodes whose row is empty are missing. ``Blocked.step`` does the same by blocks."""
    return edges.join(columns.select(F.col("id").alias("j"), *names), "j").groupBy(F.col("i").alias("id")).agg(*[F.expr(f"sum(w * {c})").alias(c) for c in names])


def combined(table: DataFrame, names: list[str], mix: np.ndarray, to: list[str]) -> DataFrame:
    """(id, to): the columns ``names`` times the matrix ``mix``, which is small and goes with the function."""

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame(x[names].to_numpy(float) @ mix, columns=to).assign(id=x["id"].to_numpy())[["id", *to]]

    return table.select("id", *names).mapInPandas(times, "id long, " + ", ".join(f"{c} double" for c in to))


def norm_bound(edges: DataFrame) -> float:
    """The largest sum of a row's absolute values; no eigenvalue is larger."""
    return edges.groupBy("i").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0] or 0.0


def _read(raw: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def _batch(names: list[str], *values) -> pa.RecordBatch:
    """One row: an int32 first, then arrays as their bytes."""
    return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in values[1:]]], names=names)


class Blocked:
    """A matrix (i, j, w) over nodes (id) as tiles between blocks of rows, written. Columns are tables (b, v): a block's number and its rows' numbers."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        nodes = materialize(nodes.select("id").distinct(), "eigen-nodes")
        held = materialize(edges.select("i", "j", "w"), "eigen-edges")
        self.n, self.bound = nodes.count(), norm_bound(held) or 1.0
        self.parts = max(1, min(self.n // LEAST_ROWS, nodes.sparkSession.sparkContext.defaultParallelism), -(-self.n // MOST_ROWS))
        b = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("b")
        self.rows = materialize(nodes.groupBy(b).agg(F.array_sort(F.collect_list("id")).alias("ids")), "eigen-rows")
        self.places = self.rows.select("b", F.posexplode("ids").alias("k", "id"))

        def tile(e: pd.DataFrame) -> pd.DataFrame:
            e = e.sort_values(["r", "c"])
            need, at = np.unique(e["c"].to_numpy(np.int32), return_inverse=True)
            return pd.DataFrame({"to": e["to"].iloc[:1], "frm": e["frm"].iloc[:1], "need": [need.tobytes()], "r": [e["r"].to_numpy(np.int32).tobytes()], "c": [at.astype(np.int32).tobytes()], "w": [e["w"].to_numpy(float).tobytes()]})

        placed = held.join(self.places.toDF("to", "r", "i"), "i").join(self.places.toDF("frm", "c", "j"), "j").select("to", "frm", "r", "c", "w")
        self.tiles = materialize(placed.groupBy("to", "frm").applyInPandas(tile, "to int, frm int, need binary, r binary, c binary, w binary"), "eigen-tiles")
        asked = self.tiles.groupBy(F.col("frm").alias("b")).agg(F.collect_list(F.struct("to", "need")).alias("s"))
        self.asked = materialize(asked.select("b", F.col("s.to").alias("to"), F.col("s.need").alias("need")), "eigen-asked")
        discard(nodes, held)

    def discard(self) -> None:
        discard(self.rows, self.tiles, self.asked)

    def drawn(self, seed: int, width: int) -> DataFrame:
        """Normal columns; written."""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for b, ids in zip(x.column(0).to_pylist(), x.column(1)):
                    yield _batch(["b", "v"], b, normals(seed, ids.values.to_numpy(), width))

        return materialize(self.rows.mapInArrow(draw, "b int, v binary"), "eigen")

    def step(self, now: DataFrame, before: DataFrame | None, width: int) -> DataFrame:
        """(b, v, gram) after ``now`` by the recurrence, or the matrix times it without ``before``; gram is [now, v]' [now, v] of the block. Written."""
        bound = self.bound

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for b, body, to, need in zip(x.column(0).to_pylist(), x.column(1), x.column(2).to_pylist(), x.column(3)):
                    v = _read(body).reshape(-1, width)
                    for other, rows in zip(to, need.values):
                        yield pa.RecordBatch.from_arrays([pa.array([other], pa.int32()), pa.array([3], pa.int32()), pa.array([b], pa.int32()), pa.array([v[_read(rows, np.int32)].tobytes()], pa.binary())], names=["to", "kind", "frm", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = None

            def done() -> pa.RecordBatch:
                after = total / bound if last is None else 2 / bound * total - last
                both = np.hstack([held, after])
                return _batch(["b", "v", "gram"], at, after, both.T @ both)

            for x in batches:
                for to, kind, body, r, c in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(3), x.column(4), x.column(5)):
                    if to != at:
                        if at is not None:
                            yield done()
                        at, last = to, None
                    if kind == 0:
                        last = _read(body).reshape(-1, width).copy()
                    elif kind == 1:
                        held = _read(body).reshape(-1, width).copy()
                        total = np.zeros_like(held)
                    elif kind == 2:
                        row, col, w = _read(r, np.int32).copy(), _read(c, np.int32).copy(), _read(body).copy()
                    else:
                        # Rows in order, so that each is one sum.
                        first = np.flatnonzero(np.diff(row, prepend=-1))
                        total[row[first]] += np.add.reduceat(w[:, None] * _read(body).reshape(-1, width)[col], first, axis=0)
            if at is not None:
                yield done()

        sent = now.select("b", "v").join(self.asked, "b").mapInArrow(send, "to int, kind int, frm int, v binary")
        nothing = [F.lit(None).cast("binary").alias(c) for c in "rc"]
        met = sent.select("*", *nothing).union(self.tiles.select("to", F.lit(2), "frm", "w", "r", "c"))
        for kind, own in enumerate((before, now)):
            if own is not None:
                met = met.union(own.select("b", F.lit(kind), F.lit(-1), "v", *nothing))
        dealt = met.repartitionById(self.parts, "to").sortWithinPartitions("to", "frm", "kind")
        return materialize(dealt.mapInArrow(add, "b int, v binary, gram binary"), "eigen")

    def summed(self, tables: list[DataFrame], mixes: np.ndarray, width: int) -> DataFrame:
        """(b, v): the sum of tables of columns, each times its matrix, which is small and goes with the function. Written."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = total = None
            for x in batches:
                for b, q, body in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2)):
                    part = _read(body).reshape(-1, width) @ mixes[q]
                    if b != at:
                        if at is not None:
                            yield _batch(["b", "v"], at, total)
                        at, total = b, part
                    else:
                        total += part
            if at is not None:
                yield _batch(["b", "v"], at, total)

        terms = tables[0].select("b", F.lit(0).alias("q"), "v")
        for q, table in enumerate(tables[1:], 1):
            terms = terms.union(table.select("b", F.lit(q), "v"))
        return materialize(terms.repartitionById(self.parts, "b").sortWithinPartitions("b", "q").mapInArrow(add, "b int, v binary"), "eigen")

    def vectors(self, columns: DataFrame, width: int, k: int) -> DataFrame:
        """(id, v): the first k columns as arrays, each turned so that its entry of largest size, the smallest id's of equals, is positive; written."""

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for ids, body in zip(x.column(0), x.column(1)):
                    v, ids = _read(body).reshape(-1, width)[:, :k], ids.values.to_numpy()
                    row = np.abs(v).argmax(0)  # ids are in order
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"c": np.arange(k), "id": ids[row], "x": v[row, np.arange(k)]}), preserve_index=False)

        both = self.rows.join(columns, "b").select("ids", "v")
        largest = both.mapInArrow(top, "c long, id long, x double").groupBy("c").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("id"))).alias("x")).toPandas()
        turn = np.ones(k)
        turn[largest["c"]] = np.where(largest["x"] < 0, -1.0, 1.0)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for ids, body in zip(x.column(0), x.column(1)):
                    v = _read(body).reshape(-1, width)[:, :k] * turn
                    yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(np.arange(0, v.size + 1, k, dtype=np.int32), v.ravel())], names=["id", "v"])

        return materialize(both.mapInArrow(spread, "id long, v array<double>"), "eigenvectors")


def _moments(steps: list[DataFrame], b: int) -> list[np.ndarray]:
    """<V, T_q V> for q = 0 .. 2 * len(steps), from the inner products within each step's table (T_q-1 V, T_q V) of b columns."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for x in batches:
            for q, g in zip(x.column(0).to_pylist(), x.column(1)):
                total[q] = total.get(q, 0) + _read(g)
        for q, g in total.items():
            yield _batch(["q", "g"], q, g)

    each = steps[0].select(F.lit(0).alias("q"), "gram")
    for q, s in enumerate(steps[1:], 1):
        each = each.union(s.select(F.lit(q), "gram"))
    grams = np.zeros((len(steps), 4 * b * b))
    for q, g in each.mapInArrow(products, "q int, g binary").collect():  # a few kB for each task
        grams[q] += np.frombuffer(g)
    grams = grams.reshape(-1, 2 * b, 2 * b)
    out = [grams[0][:b, :b], grams[0][:b, b:]]
    for q in range(1, len(steps) + 1):  # step q - 1 holds T_q-1 and T_q
        g = grams[q - 1]
        if q > 1:
            out.append(2 * g[:b, b:] - out[1])  # 2 q - 1, as <T_q-1, T_q> is half of it and of the first
        out.append(2 * g[b:, b:] - out[0])  # 2 q
    return [(m + m.T) / 2 for m in out]


def _ritz(moments: list[np.ndarray], scale: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, coefficients (q, block, vectors), residuals) of the k largest Ritz values in the span of T_0 V .. T_m-1 V; moments go to 2 m."""
    b = len(moments[0])
    m = (len(moments) - 1) // 2
    n = (m + 1) * b
    gram = np.zeros((n, n))
    for p in range(m + 1):
        for q in range(m + 1):
            gram[p * b : (p + 1) * b, q * b : (q + 1) * b] = (moments[p + q] + moments[abs(p - q)]) / 2
    times = np.zeros((n, m * b))  # the matrix times T_q, in the T
    for q in range(m):
        for c in range(b):
            if q == 0:
                times[b + c, c] = 1
            else:
                times[(q + 1) * b + c, q * b + c] = times[(q - 1) * b + c, q * b + c] = 0.5
    inner = gram[: m * b, : m * b]
    size = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    w, u = np.linalg.eigh(inner / size / size[:, None])
    kept = w > NOISE * w[-1]
    white = u[:, kept] / np.sqrt(w[kept]) / size[:, None]
    a = white.T @ (gram @ times)[: m * b] @ white
    values, y = np.linalg.eigh((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    values, y = values[order], white @ y[:, order]
    rest = times @ y
    rest[: m * b] -= y * values
    residual = np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", rest, gram, rest), 0))
    return values * scale, y.reshape(m, b, -1), residual * scale


def extreme_eigenpairs(edges: DataFrame, nodes: DataFrame, k: int, largest: bool = True, tolerance: float = 1e-4, most_cycles: int = 40, steps: int = STEPS, more: int = MORE, seed: int = 42) -> Eigenpairs:
    """The k largest (or smallest) eigenpairs of the symmetric matrix ``edges`` (i, j, w) over ``nodes`` (id).

    Ends when every residual is at most ``tolerance`` times the norm's bound, or
    after ``most_cycles``; ``residuals`` tell. An eigenvalue's error is no more than
    its residual, and near the residual's square over the gap. Signs: each vector's
    entry of largest size, the smallest id's of equals, is positive. Fewer nodes than
    k give as many pairs as there are; no nodes give none. A node without edges is an
    eigenvector of 0. Equal (i, j) are summed.
    """
    a = Blocked(edges.select("i", "j", F.col("w") if largest else (-F.col("w")).alias("w")), nodes)
    n, bound = a.n, a.bound
    k = min(k, n)
    if not k:
        a.discard()
        return Eigenpairs(np.zeros(0), nodes.select("id", F.array().cast("array<double>").alias("v")).limit(0), np.zeros(0), 0)
    block = min(n, k + more)
    # Small spaces end early: no more directions than nodes.
    steps = max(1, min(steps, -(-n // block) + 1))
    state = a.drawn(seed, block)
    cycle, done = 0, False
    while not done and cycle < most_cycles:
        cycle += 1
        terms = [state]  # T_0, T_1 ..
        for _ in range(steps):
            terms.append(a.step(terms[-1], terms[-2] if len(terms) > 1 else None, block))
        values, y, residuals = _ritz(_moments(terms[1:], block), bound, block)
        width = y.shape[2]
        done = width < block or residuals[:k].max(initial=0.0) <= tolerance * bound
        state = a.summed(terms[:steps], y, block)
        discard(*terms)
    k = min(k, width)
    vectors = a.vectors(state, width, k)
    discard(state)
    a.discard()
    return Eigenpairs(values[:k] if largest else -values[:k], vectors, residuals[:k], cycle)


def spectral_entropies(edges: DataFrame, nodes: DataFrame, t_max: int, known: Eigenpairs, probes: int = 24, steps: int = 14, seed: int = 7) -> np.ndarray:
    """Von Neumann entropies of the powers 1 .. t_max of a symmetric matrix, without its spectrum.

    Stochastic Lanczos quadrature: for random columns v, <v, f(A) v> has a Gauss
    rule from the moments <v, T_q v>, and its mean over columns is the trace of
    f(A). ``known`` leading eigenpairs, of which high powers consist, are taken off
    the columns and counted exactly. The entropy of sigma^t over its sum Z is
    ln Z - t / Z * sum of sigma^t ln sigma.
    """
    a = Blocked(edges, nodes)
    n, bound, k = a.n, a.bound, len(known.values)
    state = a.drawn(seed, probes)
    if k:

        def pack(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"b": x["b"].iloc[:1], "u": [np.stack(x.sort_values("k")["v"].to_numpy()).astype(float).tobytes()]})

        packed = a.places.join(known.vectors, "id").select("b", "k", "v").groupBy("b").applyInPandas(pack, "b int, u binary")
        both = materialize(state.join(packed, "b").select("b", "v", "u"), "entropy")

        def onto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, probes))
            for x in batches:
                for v, u in zip(x.column(1), x.column(2)):
                    total += _read(u).reshape(-1, k).T @ _read(v).reshape(-1, probes)
            yield _batch(["q", "g"], 0, total)

        share = sum(np.frombuffer(r["g"]) for r in both.mapInArrow(onto, "q int, g binary").collect()).reshape(k, probes)  # a few kB for each task

        def off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for b, v, u in zip(x.column(0).to_pylist(), x.column(1), x.column(2)):
                    yield _batch(["b", "v"], b, _read(v).reshape(-1, probes) - _read(u).reshape(-1, k) @ share)

        discard(state)
        state = materialize(both.mapInArrow(off, "b int, v binary"), "entropy")
        discard(both)
    terms = [state]
    for _ in range(steps):
        terms.append(a.step(terms[-1], terms[-2] if len(terms) > 1 else None, probes))
    moments = _moments(terms[1:], probes)
    discard(*terms)
    a.discard()
    sigma, weight = [np.abs(known.values)], [np.ones(k)]
    total = sum(float(moments[0][c, c]) for c in range(probes)) or 1.0
    for c in range(probes):
        own = [m[c : c + 1, c : c + 1] for m in moments]
        if own[0][0, 0] <= 0:
            continue
        values, y, _ = _ritz(own, bound, steps)
        sigma.append(np.abs(values))
        weight.append(np.array([sum(y[q, 0, r] * own[q][0, 0] for q in range(steps)) for r in range(y.shape[2])]) ** 2 * max(n - k, 0) / total)
    s, w = np.concatenate(sigma), np.concatenate(weight)
    s, w = s[s > 0], w[s > 0]
    out = []
    for t in range(1, t_max + 1):
        z = float(np.sum(w * s**t))
        out.append(float(np.log(z) - t / z * np.sum(w * s**t * np.log(s))) if z > 0 else 0.0)
    return np.array(out)
