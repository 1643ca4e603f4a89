"""Nearest neighbours by vantage-point trees, one per shard.

Yianilos, "Data Structures and Algorithms for Nearest Neighbor Search in General
Metric Spaces" (SODA 1993). Vectors of length 1 have Euclidean distances that
order as cosines do, and those are a metric. A node holds a vantage point and
the radius that halves its vectors; a half is skipped if the triangle inequality
proves that nothing in it can be nearer than the k-th found so far.

``factor`` relaxes that: the bound is compared with the k-th distance divided by
it, so a larger factor skips more and may miss some. Factor 1 is exact search.

Shards are dealt by place: a vector belongs to the nearest of at most MOST_CELLS
pivots, vectors of smallest hash, and a cell of more than SHARD_ROWS vectors is
dealt into shards by a hash, so a tree always fits a task. Each cell has a radius.
A query searches its own cell first; the k-th distance found there then rules
out, by the same inequality and factor, cells that are too far, and prunes within
the others from the start. Queries travel in blocks; in a task a shard's vectors
come first, are made a tree, and the blocks stream past it. Every (query, shard)
gives at most k rows, and a ranked window keeps the best.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, groups_of, materialize, released

SHARD_ROWS = 8192
LEAF_ROWS = 256
QUERY_ROWS = 256
#: Pivots are broadcast: at most so many vectors.
MOST_CELLS = 1024
#: Pairs that are scored at once.
SCORED = 1 << 15
#: Two cosines nearer than this may be equal; both are then computed exactly.
NOISE = 1e-12


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and b, summed from the first component on, so they don't depend on blocking."""
    dot, aa, bb = (np.cumsum(x * y, axis=1)[:, -1] for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Tree:
    """A vantage-point tree over the rows of ``vectors``, as flat arrays.

    Node: (vantage row, radius, inner node, outer node, first, last). Rows are
    ordered so that a node's are neighbours. Vantage points are chosen as the
    row of the largest spread of distances among a few seeded candidates.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        length = np.sqrt(np.cumsum(vectors * vectors, axis=1)[:, -1])
        unit = vectors / length[:, None]
        order = np.arange(len(ids))
        rng = np.random.default_rng(len(ids))
        self.nodes: list[list] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            k = len(self.nodes)
            self.nodes.append([None, 0.0, -1, -1, first, last])
            if parent >= 0:
                self.nodes[parent][2 + side] = k
            if last - first <= leaf_rows:
                continue
            rows = order[first:last]
            tried = rng.choice(rows, min(8, len(rows)), replace=False)
            probe = unit[rng.choice(rows, min(64, len(rows)), replace=False)]
            vantage = unit[tried[np.argmax(np.var(_distance(unit[tried], probe), axis=1))]]
            d = _distance(vantage[None], unit[rows])[0]
            radius = np.median(d)
            inner = d <= radius
            if inner.all() or not inner.any():
                inner = d < radius
                if inner.all() or not inner.any():
                    continue  # all at one distance: a leaf of any size, bounded by the shard
            far = d[~inner].min()
            order[first:last] = np.concatenate([rows[inner], rows[~inner]])
            middle = first + int(inner.sum())
            self.nodes[k][:2] = [vantage, (float(d[inner].max()), float(far))]
            todo += [(first, middle, k, 0), (middle, last, k, 1)]
        self.ids, self.vectors, self.unit = ids[order], vectors[order], unit[order]

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query row, id, cosine) of up to k nearest rows of each query, its own id excepted, and how many cosines were computed.

        ``known``: a cosine that k rows elsewhere reach; what is below it isn't looked for.
        """
        unit = vectors / np.sqrt(np.cumsum(vectors * vectors, axis=1)[:, -1])[:, None]
        worst = np.full((len(ids), k), -np.inf)  # the k best cosines, unordered
        if known is not None:
            worst[:] = known[:, None]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        looked = 0
        todo = [(0, np.arange(len(ids)), np.zeros(len(ids)))]
        while todo:
            node, rows, bound = todo.pop()
            limit = np.sqrt(np.maximum(2 - 2 * worst[rows].min(axis=1), 0)) / factor
            rows = rows[~(bound > limit + 1e-7)]
            if not len(rows):
                continue
            vantage, radius, inner, outer, first, last = self.nodes[node]
            if inner < 0:
                c = unit[rows] @ self.unit[first:last].T
                c[ids[rows][:, None] == self.ids[None, first:last]] = -np.inf
                looked += c.size
                best = np.concatenate([worst[rows], c], axis=1)
                worst[rows] = -np.partition(-best, k - 1, axis=1)[:, :k]
                q, at = np.nonzero((c >= worst[rows].min(axis=1)[:, None] - NOISE) & (c > -np.inf))
                found.append((rows[q], first + at, c[q, at]))
                continue
            d = _distance(vantage[None], unit[rows])[0]
            to_inner, to_outer = np.maximum(d - radius[0], 0), np.maximum(radius[1] - d, 0)
            near = to_inner <= to_outer
            for part in (~near, near):  # the last pushed is searched first
                if part.any():
                    a, b = (inner, to_inner), (outer, to_outer)
                    first_, second = (a, b) if part is near else (b, a)
                    todo += [(second[0], rows[part], second[1][part]), (first_[0], rows[part], first_[1][part])]
        if not found:
            return np.empty(0, int), np.empty(0, np.int64), np.empty(0), looked
        q, at, c = (np.concatenate(x) for x in zip(*found))
        keep = c >= worst[q].min(axis=1) - NOISE
        q, at = q[keep], at[keep]
        if not len(q):
            return np.empty(0, int), np.empty(0, np.int64), np.empty(0), looked
        # Ties with a very common vector can be many: their vectors are paired a part at a time.
        score = np.concatenate([exact_cosine(vectors[q[s : s + SCORED]], self.vectors[at[s : s + SCORED]]) for s in range(0, len(q), SCORED)])
        order = np.lexsort((self.ids[at], -score, q))
        q, at, score = q[order], at[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        top = place < k
        return q[top], self.ids[at[top]], score[top], looked


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) in double precision, without null ids and vectors that are null, empty, zero or hold null, NaN or infinity."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _pivots(held: DataFrame, many: int) -> dict[int, np.ndarray]:
    """Unit vectors of smallest hash, by their dimensions; vectors of other dimensions have no pivot and one cell."""
    rows = held.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(many).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {d: (lambda x: x / np.sqrt((x * x).sum(1, keepdims=True)))(np.array(v, float)) for d, v in by.items()}


def _placed(rows: DataFrame, pivots) -> DataFrame:
    """(vec_id, v, dim, cell, far): the nearest pivot of each vector and the distance of their unit vectors; written."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim = b["v"].map(len).to_numpy()
            cell, far = np.zeros(len(b), np.int32), np.full(len(b), np.inf)
            for d in np.unique(dim):
                if d in pivots.value:
                    at = np.flatnonzero(dim == d)
                    x = np.stack(b["v"].to_numpy()[at]).astype(float)
                    gap = _distance(x / np.sqrt((x * x).sum(1, keepdims=True)), pivots.value[d])
                    cell[at] = gap.argmin(1)
                    far[at] = gap.min(1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "dim": dim.astype(np.int32), "cell": cell, "far": far})

    return materialize(rows.mapInPandas(place, "vec_id long, v array<double>, dim int, cell int, far double"), "ann-placed")


def _bodies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): the ids, vectors and known cosines of each group, as one row."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        body = pickle.dumps((rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(float), rows["known"].to_numpy(float)))
        return pd.DataFrame({**{c: rows[c].iloc[:1] for c in keys}, "body": [body]})

    return rows.select(*keys, "vec_id", "v", "known").groupBy(*keys).applyInPandas(gather, ", ".join(f"{c} int" for c in keys) + ", body binary")


def _dealt(rows: DataFrame, per_group: int, to: str) -> DataFrame:
    """Adds ``to``, a number below ceil(rows of the cell / per_group), by a hash; and ``groups``, how many there are. A vec_id alone could be hot, so the vector takes part."""
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / per_group).cast("int").alias("groups"))
    return rows.join(sizes, ["dim", "cell"]).withColumn(to, F.pmod(F.xxhash64("vec_id", "v"), "groups").cast("int"))


def _searched(shards: DataFrame, parts: DataFrame, probes: DataFrame, k: int, factor: float, leaf_rows: int, query_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of every probe (vec_id, v, known, dim, cell) in every shard of its cell; written."""
    blocks = _bodies(_dealt(probes, query_rows, "block"), ["dim", "cell", "block"])
    sent = blocks.join(parts, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(1).alias("kind"), "body")
    both = shards.select("dim", "cell", "part", F.lit(0).alias("kind"), "body").union(sent).repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = of = tree = None
        for b in batches:
            for *at, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    held, of, tree = body, at, None
                elif of == at:
                    if tree is None:  # only for a shard that some block asks
                        tree = Tree(*pickle.loads(held)[:2], leaf_rows)
                    ids, v, known = pickle.loads(body)
                    q, to, score, _ = tree.search(ids, v, k, factor, known)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(to), pa.array(score)], names=["query_id", "vec_id", "score"])

    return materialize(both.mapInArrow(released(look), "query_id long, vec_id long, score double"), "ann-hits")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest of every query.

    Largest cosine first, ties to the smaller vec_id; fewer if there are fewer
    candidates. Unusable vectors take no part on either side. Vectors of other
    dimensions than a query's aren't its candidates. A vec_id names a row: rows
    with the query's id aren't its candidates, and of repeated rows, with one
    vec_id and one vector, one counts; of one vec_id with several vectors, each
    does. An empty side gives an empty result. Other columns, of any name, aren't
    read.
    """
    spark = vectors.sparkSession
    held = materialize(usable(vectors, vec_id, vector).distinct(), "ann")
    pivots = spark.sparkContext.broadcast(_pivots(held, min(MOST_CELLS, groups_of(held.count(), shard_rows))))
    placed = _placed(held, pivots)
    parted = _dealt(placed.withColumn("known", F.lit(float("-inf"))), shard_rows, "part")
    shards = materialize(_bodies(parted, ["dim", "cell", "part"]), "ann-shards")
    # A row for each cell: at most MOST_CELLS, and one for each number of dimensions without a pivot.
    cells = materialize(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("groups"), F.max("far").alias("radius")), "ann-cells")
    parts = cells.select("dim", "cell", "groups")
    asked = _placed(usable(queries, vec_id, vector).distinct(), pivots)
    own = _searched(shards, parts, asked.withColumn("known", F.lit(float("-inf"))), k, factor, leaf_rows, query_rows)
    reached = own.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).alias("kth"))
    found = own
    radii: dict[int, list] = {}
    for r in cells.collect():
        radii.setdefault(r["dim"], []).append((r["cell"], r["radius"]))
    if any(len(x) > 1 for x in radii.values()):

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                known = b["kth"].fillna(-np.inf).to_numpy(float)
                picked = [np.empty(0, np.int32)] * len(b)
                dim, cell = b["dim"].to_numpy(), b["cell"].to_numpy()
                for d in np.unique(dim):
                    if len(radii[d]) < 2 or d not in pivots.value:
                        continue
                    at = np.flatnonzero(dim == d)
                    numbers, radius = (np.array(x) for x in zip(*radii[d]))
                    x = np.stack(b["v"].to_numpy()[at]).astype(float)
                    gap = _distance(x / np.sqrt((x * x).sum(1, keepdims=True)), pivots.value[d][numbers]) - radius[None]
                    limit = np.sqrt(np.maximum(2 - 2 * known[at], 0)) / factor
                    may = (gap <= limit[:, None] + 1e-7) & (numbers[None] != cell[at, None])
                    for row, m in zip(at, may):
                        picked[row] = numbers[m].astype(np.int32)
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "dim": dim, "known": known, "cells": picked})

        # The k-th of all that an id has found bounds each of its vectors: results are ranked by id.
        bounds = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select("vec_id", "v", "dim", "cell", "kth")
        probes = bounds.mapInPandas(choose, "vec_id long, v array<double>, dim int, known double, cells array<int>")
        probes = materialize(probes.select("vec_id", "v", "dim", "known", F.explode("cells").alias("cell")), "ann-probes")
        found = own.union(_searched(shards, parts, probes, k, factor, leaf_rows, query_rows))
        discard(probes)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    discard(held, placed, asked, shards, cells)
    return out
