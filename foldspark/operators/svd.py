"""Singular values of tall tables: QR by tree reduction, and the randomised range finder on it.

A task reduces its rows to one triangular factor; factors of groups of tasks are
stacked and reduced again until few are left (Demmel, Grigori, Hoemmen and Langou,
"Communication-optimal parallel and sequential QR", 2012), so what meets is never
more than some factors. Orthonormal columns are the rows times the inverse of the
last factor. The range finder is that of Halko, Martinsson and Tropp (2011).

A dense matrix (id, features) is only scanned: its sketch is the features times a
matrix of dimensions by rank, which goes out with the function. For an edge table
both sides are tall, so sketches are tables, a column for each direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WrongDimensions
from ..functions.linalg import fix_signs
from ..materialize import discard, materialize, owning
from ..sources.matrix import shape
from ..sources.synthetic import normal
from .edges import transpose
from .eigen import combined, multiply_columns

#: Factors that are stacked at once.
FAN_IN = 64
#: Rows of a task that are reduced at once.
AT_ONCE = 8192


@dataclass
class Svd:
    """``values``; ``left`` is (id, v array<double>), ``right`` an array (dimensions, rank) or a table like ``left``."""

    values: np.ndarray
    left: DataFrame
    right: np.ndarray | DataFrame


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor with a diagonal that isn't negative; square, whatever the number of rows."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.vstack([rows, np.zeros((width - len(rows), width))])
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _reduced(factors: DataFrame, width: int) -> np.ndarray:
    """One factor of (at, r array<double>) rows: groups of FAN_IN are reduced in tasks, until one group is left for the driver."""

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.concatenate([np.asarray(x).reshape(-1, width) for x in rows.sort_values("at")["r"]]))
        return pd.DataFrame({"at": rows["to"].iloc[:1].to_numpy(), "r": [r.ravel()]})

    held = materialize(factors, "factors")
    while held.count() > FAN_IN:
        fewer = held.withColumn("to", F.expr(f"at div {FAN_IN}")).groupBy("to").applyInPandas(stack, "at long, r array<double>")
        before, held = held, materialize(fewer, "factors")
        discard(before)
    rows = held.orderBy("at").collect()  # at most FAN_IN factors
    discard(held)
    return _triangle(np.concatenate([np.asarray(r["r"]).reshape(-1, width) for r in rows])) if rows else np.zeros((width, width))


def _numbered(df: DataFrame) -> DataFrame:
    """Factors numbered by their task."""
    return df.select(F.spark_partition_id().cast("long").alias("at"), "r")


def tsqr(table: DataFrame, names: list[str]) -> np.ndarray:
    """The triangular factor of the columns ``names``. Rows that come to none, and an empty table, give zeros."""

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, len(names)))
        for x in batches:
            for s in range(0, len(x), AT_ONCE):
                r = _triangle(np.vstack([r, x[names].to_numpy(float)[s : s + AT_ONCE]]))
        if len(r):
            yield pd.DataFrame({"r": [r.ravel()]})

    return _reduced(_numbered(table.select(*names).mapInPandas(factor, "r array<double>")), len(names))


def inverse(r: np.ndarray) -> np.ndarray:
    """What turns columns with this triangular factor into orthonormal ones; directions that are not there become zero."""
    u, s, vt = np.linalg.svd(r)
    return vt.T @ np.diag(np.where(s > 1e-12 * s.max(initial=0), 1 / np.where(s > 0, s, 1), 0)) @ u.T


def means(matrix: DataFrame) -> np.ndarray:
    """The mean of each dimension."""
    _, dims = shape(matrix)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dims), 0
        for b in batches:
            if len(b):
                total, n = total + np.stack(b["features"].to_numpy()).sum(0), n + len(b)
        yield pd.DataFrame({"total": [total], "n": [n]})

    each = matrix.select("features").mapInPandas(add, "total array<double>, n long")
    rows = each.select("n", F.posexplode("total").alias("p", "x")).groupBy("p").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("p").collect()
    return np.array([r["x"] for r in rows])


def _pass(matrix: DataFrame, mean: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor of x w, transpose of x times x w) for the centred features x: one scan."""
    dims, width = w.shape

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, g = np.zeros((0, width)), np.zeros((dims, width))
        for b in batches:
            for s in range(0, len(b), AT_ONCE):
                x = np.stack(b["features"].to_numpy()[s : s + AT_ONCE]).astype(float) - mean
                y = x @ w
                g += x.T @ y
                r = _triangle(np.vstack([r, y]))
        if len(r):
            yield pd.DataFrame({"r": [r.ravel()], "g": [g.ravel()]})

    each = materialize(matrix.select("features").mapInPandas(both, "r array<double>, g array<double>"), "passes")
    r = _reduced(_numbered(each), width)
    rows = each.select(F.posexplode("g").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).toPandas()
    g = np.zeros(dims * width)
    g[rows["p"]] = rows["x"]
    discard(each)
    return r, g.reshape(dims, width)


def _projected(matrix: DataFrame, mean: np.ndarray, w: np.ndarray) -> DataFrame:
    """(id, v): the centred features times w."""

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": list((np.stack(b["features"].to_numpy()).astype(float) - mean) @ w)})

    return matrix.select("id", "features").mapInPandas(times, "id long, v array<double>")


def dense_svd(matrix: DataFrame, rank: int, seed: int = 42, oversample: int | None = None, rounds: int = 2, centred: bool = False) -> Svd:
    """The ``rank`` largest singular values and vectors of a matrix (id, features), written.

    Each power round is one scan. Signs: each left vector's entry of largest size,
    the smallest id's of equals, is positive.
    """
    n, dims = shape(matrix)
    oversample = oversample if oversample is not None else (rank if rank < 10 else 10)
    width = min(rank + oversample, n, dims)
    mean = means(matrix) if centred else np.zeros(dims)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    for turn in range(rounds + 1):
        r, g = _pass(matrix, mean, w)
        turned = inverse(r)
        b = g @ turned  # the features' transpose times the orthonormal sketch
        if turn < rounds:
            w = np.linalg.qr(b)[0]
    v, values, small = np.linalg.svd(b, full_matrices=False)
    rank = min(rank, len(values))
    left = materialize(_projected(matrix, mean, w @ turned @ small.T[:, :rank]), "left-vectors")
    flip = _flips(left, rank)
    turned_left = materialize(left.select("id", F.transform("v", lambda x, k: x * F.element_at(F.lit(flip.tolist()), k + 1)).alias("v")), "left-vectors")
    discard(left)
    return Svd(values[:rank], turned_left, v[:, :rank] * flip)


def _flips(vectors: DataFrame, rank: int) -> np.ndarray:
    """-1 for each column whose entry of largest size is negative."""
    top = vectors.agg(*[F.max_by(F.get("v", F.lit(c)), F.struct(F.abs(F.get("v", F.lit(c))), -F.col("id"))).alias(f"c{c}") for c in range(rank)]).first()
    return np.array([-1.0 if x is not None and x < 0 else 1.0 for x in top])


def sparse_svd(edges: DataFrame, rank: int, seed: int = 42, oversample: int | None = None, rounds: int = 2) -> Svd:
    """The ``rank`` largest singular values and vectors of an edge table (i, j, w), its rows by i and columns by j; written.

    A multiplication is a join and a sum; only triangular factors reach the driver.
    """
    held = materialize(edges.select("i", "j", "w"), "svd-edges")
    back = transpose(held)
    rows, columns = held.select("i").distinct().count(), held.select("j").distinct().count()
    oversample = oversample if oversample is not None else (rank if rank < 10 else 10)
    names = [f"c{c}" for c in range(max(1, min(rank + oversample, rows, columns)))]
    start = held.select(F.col("j").alias("id")).distinct().select("id", *[normal(seed, F.col("id"), c).alias(n) for c, n in enumerate(names)])
    y = materialize(multiply_columns(held, start, names), "svd")
    for turn in range(rounds):
        z = materialize(multiply_columns(back, combined(y, names, inverse(tsqr(y, names)), names), names), "svd")
        discard(y)
        y = materialize(multiply_columns(held, combined(z, names, inverse(tsqr(z, names)), names), names), "svd")
        discard(z)
    q = inverse(tsqr(y, names))
    b = materialize(multiply_columns(back, combined(y, names, q, names), names), "svd")
    r = tsqr(b, names)
    u, values, vt = np.linalg.svd(r.T)
    rank = min(rank, len(values))
    kept = [f"v{c}" for c in range(rank)]
    as_array = lambda df: df.select("id", F.array(*kept).alias("v"))
    left = materialize(as_array(combined(y, names, q @ u[:, :rank], kept)), "left-vectors")
    flip = _flips(left, rank)
    turn = F.lit(flip.tolist())
    signed = materialize(left.select("id", F.transform("v", lambda x, k: x * F.element_at(turn, k + 1)).alias("v")), "left-vectors")
    right = materialize(as_array(combined(b, names, inverse(r) @ vt.T[:, :rank] * flip, kept)), "right-vectors")
    discard(held, y, b, left)
    return Svd(values[:rank], signed, right)


def principal_scores(matrix: DataFrame, k: int, randomised: bool = False, seed: int = 42) -> DataFrame:
    """(id, v): scores on the first k principal axes. The covariance, or with ``randomised`` a sketch, is all that reaches the driver.

    Signs: an axis' component of largest size is positive; of ``randomised``, a score's.
    """
    _, dims = shape(matrix)
    if dims < k:
        raise WrongDimensions(f"{k} principal axes need as many features, not {dims}")
    if randomised and dims > 4 * k:
        found = dense_svd(matrix, k, seed, centred=True)
        scale = F.lit([float(x) for x in found.values])
        return owning(found.left.select("id", F.transform("v", lambda x, at: x * F.element_at(scale, at + 1)).alias("v")), found.left)
    mean = means(matrix)
    _, cov = _pass(matrix, mean, np.eye(dims))
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    return _projected(matrix, mean, fix_signs(axes[:, np.argsort(-values, kind="stable")[:k]]))
