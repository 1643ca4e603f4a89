"""Multidimensional scaling of any number of points: from rows of a power of an operator, without a table of all pairs.

1. Columns. A distance between two rows of P^t is a sum over the columns: all of
   them, or, where a number is asked for, a seeded choice that estimates it. They are
   multiplied with P as chunks of WIDTH numbers, each step one join and one sum; a
   node holds as many numbers as there are columns.
2. Placement. The chosen columns' own nodes, or the first of them, are pivots. Classical
   scaling of the pivots gives axes, and every other point has its place on these by
   its distances from the pivots (de Silva and Tenenbaum 2004).
3. Descent. In each round the points are dealt into blocks anew, by a hash of round
   and id. A block's distances are one product, and its points move towards the
   places that majorise the stress of the block's pairs (Guttman's transform), the
   less the later the round. Blocks share no points, so nothing conflicts, and a row
   travels once a round for the distances from all points of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownOption
from ..materialize import discard, materialize
from .knn import distances

#: Numbers of a row that are summed at once.
WIDTH = 32
#: Points of a block, about: its distances take 8 MB, its rows as much for each 1000 columns, and no more than BLOCK_BYTES.
BLOCK, BLOCK_BYTES = 1024, 256 << 20
#: Numbers of all pivots together, 64 MB: they go with a function.
MOST_SENT = 1 << 23
#: Steps within a block in a round.
INNER = 4


def chosen(nodes: DataFrame, most: int | None = None, seed: int = 42) -> list[int]:
    """The ids of all nodes, or of at most ``most``, by the smallest hash of seed and id, in that order."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    held = nodes.select("id", order.alias("h")).orderBy("h", "id")
    return [r["id"] for r in (held if most is None else held.limit(most)).select("id").collect()]


def power_columns(operator: DataFrame, nodes: DataFrame, columns: list[int], t: int) -> DataFrame:
    """(id, v): the entries of P^t in these columns, in their order; 0 where there are none. Written."""
    spark = operator.sparkSession
    names = [f"c{k}" for k in range(WIDTH)]
    chunks = -(-len(columns) // WIDTH)
    at = spark.createDataFrame([(int(c), k // WIDTH, k % WIDTH) for k, c in enumerate(columns)], "id long, chunk int, k int")
    state = at.select("id", "chunk", *[F.when(F.col("k") == k, 1.0).otherwise(0.0).alias(c) for k, c in enumerate(names)])
    held = None
    for _ in range(t):
        # Equal keys of the chunk make one sum a (node, chunk); a node without such a row has zeros there.
        moved = operator.join(state.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id"), "chunk").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        before, held = held, materialize(moved, "power-columns")
        state = held
        if before is not None:
            discard(before)
    nothing = F.array(*[F.lit(0.0)] * WIDTH)
    found = F.map_from_entries(F.collect_list(F.struct("chunk", F.array(*names))))
    rows = nodes.select("id").join(state.groupBy("id").agg(found.alias("m")), "id", "left")
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.coalesce(F.try_element_at("m", c), nothing)))
    out = materialize(rows.select("id", F.slice(whole, 1, len(columns)).alias("v")), "potential")
    if held is not None:
        discard(held)
    return out


def transformed(v: Column, gamma: float) -> Column:
    """The potential of each entry: -ln(entry + 1e-7) with gamma 1, the entry with -1, else its power (1 - gamma) / 2 over that; absent entries stay 0."""
    if abs(gamma + 1) < 1e-10:
        return v
    if gamma == 1:
        return F.transform(v, lambda x: F.when(x > 0, -F.ln(F.least(x, F.lit(1.0)) + 1e-7)).otherwise(0.0))
    c = (1 - gamma) / 2
    return F.transform(v, lambda x: F.when(x > 0, F.pow(x, F.lit(c)) / c).otherwise(0.0))


def between(a: np.ndarray, b: np.ndarray, metric: str, scale: float) -> np.ndarray:
    """Distances of rows of some columns, as those of all columns are expected."""
    sa, sb, dots = (a * a).sum(1), (b * b).sum(1), a @ b.T
    if metric == "cosine":
        both = np.sqrt(sa)[:, None] * np.sqrt(sb)
        return np.where(both > 0, 1 - dots / np.where(both > 0, both, 1), 0.0)
    d = np.sqrt(np.maximum(sa[:, None] + sb - 2 * dots, 0)) * scale
    if a is b:
        np.fill_diagonal(d, 0)
    return d


def pivot_axes(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pivots' distances: the mean of squares from each, and the matrix (k, pivots) that turns what squares differ from it into places."""
    sq = d * d
    mean = sq.mean(0)
    values, vectors = np.linalg.eigh(-0.5 * (sq - mean - mean[:, None] + sq.mean()))
    top = np.argsort(-values, kind="stable")[:k]
    w, u = values[top], vectors[:, top]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    axes = np.where(w > 1e-12 * max(w.max(initial=0.0), 1e-300), 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0)[:, None] * u.T
    return mean, np.vstack([axes, np.zeros((k - len(axes), len(d)))])


def placed_by_pivots(rows: DataFrame, pivots: np.ndarray, k: int, metric: str = "euclidean", scale: float = 1.0) -> DataFrame:
    """(id, x) of rows (id, v) by their distances from the pivots' rows; a pivot's place is that of classical scaling."""
    if pivots.size > MOST_SENT:
        raise ValueError(f"pivots of {pivots.size} numbers are more than {MOST_SENT}")
    mean, axes = pivot_axes(between(pivots, pivots, metric, scale), k)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = between(np.stack(b["v"].to_numpy()), pivots, metric, scale)
                yield pd.DataFrame({"id": b["id"], "x": list(-0.5 * (d * d - mean) @ axes.T)})

    return rows.select("id", "v").mapInPandas(place, "id long, x array<double>")


def majorised(x: np.ndarray, d: np.ndarray, share: float, steps: int) -> np.ndarray:
    """Some steps of Guttman's transform, each taken by ``share``; the mean stays."""
    n, mean = len(x), x.mean(0)
    x = x - mean
    for _ in range(steps):
        now = np.sqrt(np.maximum(distances(x, x, "euclidean"), 0))
        ratio = np.divide(d, now, out=np.zeros_like(d), where=now > 1e-12)
        np.fill_diagonal(ratio, 0)
        x = (1 - share) * x + share * (ratio.sum(1)[:, None] * x - ratio @ x) / n
    return x + mean


def descend(rows: DataFrame, places: DataFrame, n: int, rounds: int = 20, metric: str = "euclidean", scale: float = 1.0, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(id, x) after ``rounds`` of stress descent from ``places`` (id, x); ``rows`` (id, v). Written; ``places`` is discarded."""
    n_blocks = max(1, -(-n // block))

    def moved_by(share: float):
        def move(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("id")
            v = np.stack(b["v"].to_numpy())
            return pd.DataFrame({"id": b["id"], "x": list(majorised(np.stack(b["x"].to_numpy()), between(v, v, metric, scale), share, INNER))})

        return move

    for r in range(rounds):
        # One block holds all pairs, so nothing has to be averaged over rounds.
        move = moved_by(1.0 if n_blocks == 1 else max(0.02, 1 - r / rounds))
        dealt = rows.join(places, "id").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "id"), F.lit(n_blocks)).cast("int"))
        before, places = places, materialize(dealt.groupBy("block").applyInPandas(move, "id long, x array<double>"), "scaling")
        discard(before)
    return places


def scaled(rows: DataFrame, columns: list[int], n: int, k: int = 2, n_pivots: int = 256, rounds: int = 20, metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """(id, x): rows (id, v of these columns) placed by pivots and, with ``rounds``, by stress descent. Written."""
    if metric not in ("euclidean", "cosine"):
        raise UnknownOption(f"no metric {metric!r}; there are euclidean and cosine")
    marks = columns[: max(k + 1, min(n_pivots, MOST_SENT // max(len(columns), 1)))]
    known = {r["id"]: r["v"] for r in rows.where(F.col("id").isin(marks)).collect()}  # n_pivots rows at most
    pivots = np.array([known[c] for c in marks if c in known], float).reshape(-1, len(columns))
    scale = (n / len(columns)) ** 0.5
    places = materialize(placed_by_pivots(rows, pivots, k, metric, scale), "scaling")
    block = max(2, min(BLOCK, BLOCK_BYTES // (8 * max(len(columns), 1))))
    return descend(rows, places, n, rounds, metric, scale, seed, block) if rounds else places
