"""Layouts by rounds: edges lie in blocks that stay with the executors, and a round is one job over them.

Nodes are numbers 0 .. n - 1. A block has the edges of consecutive nodes, as
arrays sorted by node; it is kept by the executors and made again from a written
table where one is lost. A round sends what every block must see of the nodes (a
position or a number each) and gets back what each block's own nodes feel, so
the driver holds some numbers a node, and never edges or features. A node's sums
are made in one block, in the order of its edges: results don't depend on the
number of blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import layout_pacmap, layout_tsne, layout_umap, linalg
from ..materialize import discard, materialize
from . import epochs

#: Edges of a block, about, and nodes that are worth a block; edges that are computed at once.
MOST_EDGES, LEAST_NODES, AT_ONCE = 1 << 20, 128, 1 << 16
#: Rows of an array that go to a task or come from it in one piece.
PIECE = 1 << 16


# Arrays and tables

def places(matrix: DataFrame) -> DataFrame:
    """(id, place): consecutive numbers in order of id, by a range partitioning and counts of its parts; written."""
    part = materialize(matrix.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "places")
    counts = part.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__start"))
    out = materialize(part.join(starts, "__p").select("id", (F.col("__start") + F.col("__k")).alias("place")), "places")
    discard(part)
    return out


def placed(edges: DataFrame, places: DataFrame, *more: str) -> DataFrame:
    """Edges of ids as edges of places."""
    return edges.join(places.toDF("i", "pi"), "i").join(places.toDF("j", "pj"), "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), *more)


def arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """Numeric columns of a table as arrays: bytes come to the driver, no rows."""
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=names)

    kinds = {"double": np.float64, "float": np.float32, "bigint": np.int64, "int": np.int32}
    rows = df.mapInArrow(pack, ", ".join(f"`{c}` binary" for c in names)).collect()
    return {c: np.concatenate([np.frombuffer(r[c], kinds[t]) for r in rows] or [np.empty(0, kinds[t])]) for c, t in df.dtypes}


def table(spark: SparkSession, ids: np.ndarray, x: np.ndarray, name: str = "x") -> DataFrame:
    """(id long, x array<double>) of rows of an array, sent as bytes; of a flat one (id, x double)."""
    flat = x.ndim == 1
    rows = [(bytearray(np.ascontiguousarray(ids[s : s + PIECE], np.int64)), bytearray(np.ascontiguousarray(x[s : s + PIECE], float))) for s in range(0, len(ids), PIECE)]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in zip(*(c.to_pylist() for c in b.columns)):
                at, values = np.frombuffer(i, np.int64), np.frombuffer(v)
                wide = len(values) // len(at)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values) if flat else pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, wide, dtype=np.int32)), pa.array(values))], names=["id", name])

    sent = spark.createDataFrame(rows, "id binary, v binary").repartition(max(1, len(rows)))
    return sent.mapInArrow(unpack, f"id long, {name} {'double' if flat else 'array<double>'}")


def in_one_task(matrix: DataFrame, edges: DataFrame, n: int, dims: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]) -> bytes:
    """work(features by place, i, j) in a task, from rows (place, features) and edges (i, j) of places, by i and j; only its bytes reach the driver."""
    rows = matrix.select(F.lit(True).alias("row"), F.col("place").alias("a"), F.lit(0).cast("long").alias("b"), "features")
    both = rows.union(edges.select(F.lit(False), "i", "j", F.lit(None).cast("array<double>"))).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, i, j = np.zeros((n, dims)), [], []
        for b in batches:
            row = b.column(0)
            own, other = (b.filter(row), b.filter(pa.compute.invert(row)))
            if own.num_rows:
                x[own.column(1).to_numpy()] = own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            i.append(other.column(1).to_numpy().astype(np.int32))
            j.append(other.column(2).to_numpy().astype(np.int32))
        i, j = np.concatenate(i or [np.empty(0, np.int32)]), np.concatenate(j or [np.empty(0, np.int32)])
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        del order
        yield pa.RecordBatch.from_arrays([pa.array([work(x, i, j)], pa.binary())], names=["out"])

    return bytes(both.mapInArrow(run, "out binary").collect()[0]["out"])


# Blocks

class Blocks:
    """Rows (own, other and further numbers) by blocks of their own node, sorted by ``order``, own and other."""

    def __init__(self, rows: DataFrame, n: int, order: tuple[str, ...] = ()):
        spark = rows.sparkSession
        context, names = spark.sparkContext, [c for c in rows.columns if c != "own"]
        self.n, self.context, self.total = n, context, rows.count()
        count = max(1, min(n // LEAST_NODES, max(context.defaultParallelism, -(-self.total // MOST_EDGES))))

        def pack(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            b = int(left["b"].iloc[0])
            lo, hi = -(-b * n // count), -(-(b + 1) * n // count)
            right = right.sort_values([*order, "own", "other"])
            held = {c: right[c].to_numpy(np.int32 if right[c].dtype.kind == "i" else float) for c in names}
            held |= {"own": (right["own"].to_numpy() - lo).astype(np.int32), "lo": lo, "hi": hi}
            return pd.DataFrame({"b": [b], "body": [pickle.dumps(held, pickle.HIGHEST_PROTOCOL)]})

        every = spark.range(count).withColumnRenamed("id", "b")
        dealt = rows.withColumn("b", F.expr(f"own * {count} div {n}"))
        self.written = materialize(every.groupBy("b").cogroup(dealt.groupBy("b")).applyInPandas(pack, "b long, body binary"), "blocks")
        self.rows = self.written.rdd.map(lambda r: (r["b"], bytes(r["body"]))).partitionBy(count, int).persist(StorageLevel.MEMORY_AND_DISK)

    def round(self, work: Callable, sent) -> list:
        """``work`` of each block and of what is sent to all, in order of the blocks' nodes."""
        out = self.each(work, sent)
        return [x for _, x in sorted(out, key=lambda kv: kv[0])]

    def each(self, work: Callable, sent) -> list:
        held = self.context.broadcast(sent)
        try:
            return self.rows.map(lambda kv: (kv[0], work(pickle.loads(kv[1]), held.value))).collect()
        finally:
            held.destroy()

    def close(self) -> None:
        self.rows.unpersist()
        discard(self.written)


def _pieces(own: np.ndarray, n: int, at_once: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(first edge, last, first node, last) of pieces of edges sorted by node; a node's edges stay together."""
    at_once = at_once or AT_ONCE
    first = s = 0
    while s < len(own):
        e = s + at_once
        # The node that the piece would cut begins the next one, unless it is all there is.
        last = n if e >= len(own) else max(int(own[e]), first + 1)
        e = len(own) if last == n else int(np.searchsorted(own, last))
        yield s, e, first, last
        first, s = last, e


# t-SNE

def _tsne(block: dict, sent: tuple, o: layout_tsne.TsneOptions, method: str) -> tuple:
    y, exaggeration, radii = sent
    lo, hi, own, j, w = (block[k] for k in ("lo", "hi", "own", "other", "w"))
    n = hi - lo
    pull, sums = np.zeros((n, 2)), np.zeros((n, 2)) if radii else None
    for s, e, a, b in _pieces(own, n):
        i = own[s:e] + lo
        pull[a:b] = layout_tsne.attraction(y, own[s:e] - a, i, j[s:e], w[s:e] * exaggeration, b - a)
        if radii:
            sums[a:b] = layout_tsne.radii_sums(y, own[s:e] - a, i, j[s:e], b - a)
    return *layout_tsne.repulsion_of(method, o)(y, slice(lo, hi)), pull, sums


def _tsne_density(block: dict, sent: tuple) -> np.ndarray:
    y, share = sent
    lo, n, own, j = block["lo"], block["hi"] - block["lo"], block["own"], block["other"]
    out = np.zeros((n, 2))
    for s, e, a, b in _pieces(own, n):
        out[a:b] = layout_tsne.density_pull(y, own[s:e] - a, own[s:e] + lo, j[s:e], share, b - a)
    return out


def tsne(blocks: Blocks, y: np.ndarray, o: layout_tsne.TsneOptions, method: str, density: layout_umap.Density | None = None) -> np.ndarray:
    """t-SNE's descent (``layout_tsne.descend``) of blocks (own, other, w); a round an epoch, two where the density term is active."""
    layout_tsne.repulsion_of(method, o)

    def forces(y: np.ndarray, exaggeration: float, active: bool) -> tuple:
        push, q, pull, sums = zip(*blocks.round(partial(_tsne, o=o, method=method), (y, exaggeration, active)))
        less = np.concatenate(blocks.round(_tsne_density, (y, layout_tsne.density_shares(np.concatenate(sums), density)))) if active else None
        return np.concatenate(push), np.concatenate(q), np.concatenate(pull), less

    return layout_tsne.descend(y, o, forces, density)


# PaCMAP

#: Numbers of the kinds of pairs.
KINDS = {"near": 0, "mid_near": 1, "further": 2}


def pair_blocks(pairs: DataFrame, n: int) -> Blocks:
    """Pairs (kind, i, j) at both ends: side 0 of i, side 1 of j."""
    kind = F.when(F.col("kind") == "near", 0).when(F.col("kind") == "mid_near", 1).otherwise(2).alias("kind")
    own = pairs.select(F.col("i").alias("own"), F.col("j").alias("other"), kind, F.lit(0).alias("side"))
    return Blocks(own.union(pairs.select("j", "i", kind, F.lit(1))), n, ("kind", "side"))


def _pacmap(block: dict, sent: tuple) -> np.ndarray:
    x, weights = sent
    lo, n = block["lo"], block["hi"] - block["lo"]
    out = np.zeros((n, x.shape[1]))
    key = block["kind"] * 2 + block["side"]
    cuts = np.searchsorted(key, np.arange(7))
    for kind in range(3):
        sides = [slice(cuts[2 * kind + side], cuts[2 * kind + side + 1]) for side in (0, 1)]
        if not weights[kind]:
            continue
        for side, at in enumerate(sides):
            own, other = block["own"][at], block["other"][at]
            for s, e, a, b in _pieces(own, n):
                i, j = own[s:e] + lo, other[s:e]
                g = layout_pacmap.pulls(x, *((i, j) if side == 0 else (j, i)), kind, weights[kind])
                for c in range(x.shape[1]):
                    sums = np.bincount(own[s:e] - a, g[:, c], b - a)
                    out[a:b, c] += sums if side == 0 else -sums
    return out


def pacmap(blocks: Blocks, x: np.ndarray, n_epochs: int, lr: float, first: int, second: int) -> np.ndarray:
    """PaCMAP's descent of ``pair_blocks``."""
    def gradient(x: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
        return np.concatenate(blocks.round(_pacmap, (x, weights)))

    return layout_pacmap.descend(x, gradient, n_epochs, lr, first, second)


# UMAP

def schedule_blocks(schedule: DataFrame, n: int) -> Blocks:
    """Edges (i, j, w, e, period) with i < j at both ends: side 0 of i, side 1 of j. Side 1 before side 0 has a node's neighbours in order."""
    own = schedule.select(F.col("i").alias("own"), F.col("j").alias("other"), "w", "e", "period", F.lit(0).alias("side"))
    return Blocks(own.union(schedule.select("j", "i", "w", "e", "period", F.lit(1))), n, ("side",))


def _sides(block: dict) -> tuple[dict, dict]:
    cut = int(np.searchsorted(block["side"], 1))
    return tuple({k: block[k][at] for k in ("own", "other", "w", "e", "period") if k in block} for at in (slice(0, cut), slice(cut, None)))


def _both_sides(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, other, w) of all edges of a block, by node and then by neighbour."""
    if "side" not in block:
        return block["own"], block["other"], block["w"]
    zero, one = _sides(block)
    own, other, w = (np.concatenate([one[k], zero[k]]) for k in ("own", "other", "w"))
    order = np.argsort(own, kind="stable")
    return own[order], other[order], w[order]


def drawn_before(epoch: int, period: np.ndarray, negatives: int) -> np.ndarray:
    """Negatives that an edge has drawn by the end of an epoch in which it was due, by its own schedule."""
    return np.maximum(np.floor(epoch / (period / negatives)) - 1, 0)


def _umap(block: dict, sent: tuple, o: layout_umap.UmapOptions, seed: int, how: str) -> tuple:
    x, epoch, term = sent
    lo, n, total = block["lo"], block["hi"] - block["lo"], len(x[0])
    out, moved = [np.zeros(n) for _ in x], np.zeros(n, bool)
    sides = []
    for side in _sides(block):
        k = np.floor(epoch / side["period"])
        at = np.flatnonzero(k > np.floor((epoch - 1) / side["period"])) if epoch > 0 else np.empty(0, int)
        due = {c: v[at] for c, v in side.items()}
        if how == "scheduled":
            last = np.ceil((k[at] - 1) * due["period"])
            due["times"] = np.maximum(drawn_before(epoch, due["period"], o.negatives) - np.where(k[at] > 1, drawn_before(last, due["period"], o.negatives), 0), 0).astype(int)
        else:
            due["times"] = np.full(len(at), o.negatives)
        moved[due["own"]] = True
        sides.append(due)
    for number, due in enumerate(sides):
        own, other = due["own"], due["other"]
        for s, e, a, b in _pieces(own, n):
            p, q = (own[s:e] + lo, other[s:e]) if number == 0 else (other[s:e], own[s:e] + lo)
            for g, step in zip(out, layout_umap.attraction(x, p, q, due["w"][s:e], o, term)):
                sums = np.bincount(own[s:e] - a, step, b - a)
                g[a:b] += sums if number == 0 else -sums
    # Draws of the smaller end come before those of the larger one.
    for number, due in enumerate(sides if how == "both" else sides[:1]):
        own = due["own"]
        for s, e, a, b in _pieces(own, n, max(1, AT_ONCE // max(1, o.negatives))):
            times = due["times"][s:e]
            ends = np.cumsum(times)
            who = np.repeat(own[s:e], times)
            draw = np.arange(len(who)) - np.repeat(ends - times, times)
            tag = np.repeat(due["e"][s:e].astype(np.int64) + (epochs.OTHER_END if number else 0), times)
            node = who.astype(np.int64) + lo
            pushes = layout_umap.repulsion(x, node, layout_umap.draw_numpy(seed, node, epoch, tag, draw, total), o)
            for g, push in zip(out, pushes):
                g[a:b] += np.bincount(who - a, push, b - a)
    return out, moved


def _umap_radii(block: dict, sent: tuple, o: layout_umap.UmapOptions) -> np.ndarray:
    x = sent
    lo, n = block["lo"], block["hi"] - block["lo"]
    own, other, _ = _both_sides(block)
    sums = np.zeros((n, 2))
    for s, e, a, b in _pieces(own, n):
        phi, far = layout_umap.kernel(x, own[s:e] + lo, other[s:e], o)
        sums[a:b, 0], sums[a:b, 1] = np.bincount(own[s:e] - a, phi, b - a), np.bincount(own[s:e] - a, far, b - a)
    return sums


def umap(blocks: Blocks, x: np.ndarray, o: layout_umap.UmapOptions, seed: int, how: str = "scheduled", density: layout_umap.Density | None = None) -> np.ndarray:
    """Adam on frozen positions of ``schedule_blocks``; a round an epoch, two where the density term is active.

    Negatives are hashed draws: ``scheduled`` as many as the smaller end's schedule
    asks, ``one`` a fixed number there, ``both`` a fixed number at either end.
    """
    columns = [np.array(c, float) for c in x.T]
    n = len(x)
    m, v = [np.zeros(n) for _ in columns], [np.zeros(n) for _ in columns]
    work = partial(_umap, o=o, seed=seed, how=how)
    for epoch in range(o.n_epochs):
        term = None
        if density is not None and density.active(epoch, o.n_epochs):
            sums = np.concatenate(blocks.round(partial(_umap_radii, o=o), columns))
            term = layout_umap.DensityTerm(sums[:, 0], sums[:, 1], density)
        parts = blocks.round(work, (columns, epoch, term))
        g, moved = [np.concatenate([p[0][c] for p in parts]) for c in range(len(columns))], np.concatenate([p[1] for p in parts])
        layout_umap.adam_step(columns, m, v, g, moved, epoch, o)
    return np.stack(columns, axis=1)


# Components and eigenvectors of the graph of schedule_blocks, or of blocks (own, other, w)

def _least(block: dict, label: np.ndarray) -> np.ndarray:
    own, other, _ = _both_sides(block)
    out = label[block["lo"] : block["hi"]].copy()
    np.minimum.at(out, own, label[other])
    return out


def labels(blocks: Blocks) -> np.ndarray:
    """The least node reachable from each."""
    label = np.arange(blocks.n)
    while True:
        new = np.concatenate(blocks.round(_least, label))
        np.minimum.at(new, label, new.copy())
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _degrees(block: dict, sent: None) -> np.ndarray:
    own, _, w = _both_sides(block)
    return np.bincount(own, w, block["hi"] - block["lo"])


def _times(block: dict, sent: tuple) -> np.ndarray:
    x, s = sent
    own, other, w = _both_sides(block)
    return np.bincount(own, w * s[own + block["lo"]] * s[other] * x[other], block["hi"] - block["lo"])


def _edges(block: dict, wanted: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(label, edges) of nodes with a label that isn't negative."""
    own, other, w = _both_sides(block)
    i = own.astype(np.int64) + block["lo"]
    at = np.flatnonzero(wanted[i] >= 0)
    at = at[np.argsort(wanted[i[at]], kind="stable")]
    of = wanted[i[at]]
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
    for s, e in zip(cuts, [*cuts[1:], len(of)]):
        yield int(of[s]), (i[at[s:e]], other[at[s:e]].astype(np.int64), w[at[s:e]])


def small_parts(blocks: Blocks, number: np.ndarray, lay: Callable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """lay(part, nodes, i, j, w) of each part of ``number`` (negative: none), in tasks, edges by places among its nodes; (nodes, result) by part. A part fits a task."""
    held = blocks.context.broadcast(number)

    def one(item: tuple) -> tuple:
        part, pieces = item
        i, j, w = (np.concatenate(x) for x in zip(*sorted(pieces, key=lambda p: p[0][0])))
        nodes = np.unique(np.concatenate([i, j]))
        return part, nodes, lay(part, nodes, np.searchsorted(nodes, i), np.searchsorted(nodes, j), w)

    found = blocks.rows.flatMap(lambda kv: _edges(pickle.loads(kv[1]), held.value)).groupByKey(blocks.rows.getNumPartitions()).map(one).collect()
    held.destroy()
    return {part: (nodes, x) for part, nodes, x in found}


def leading(blocks: Blocks, degree: np.ndarray, nodes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The k leading eigenvectors of the normalised graph over the nodes of one component, by Lanczos' method; a round a step."""
    s = np.where(degree > 1e-8, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)

    def times(v: np.ndarray) -> np.ndarray:
        x = np.zeros(blocks.n)
        x[nodes] = v
        return np.concatenate(blocks.round(_times, (x, s)))[nodes]

    return linalg.lanczos(times, len(nodes), k, True, seed)[1]


def degrees(blocks: Blocks) -> np.ndarray:
    return np.concatenate(blocks.round(_degrees, None))


class Affinity:
    """exp(-d2 / the largest d2) between rows, 0 on the diagonal, over the roots of its degrees: only products, by blocks of rows in tasks, never the matrix."""

    def __init__(self, spark: SparkSession, rows: np.ndarray, at_once: int = 256):
        self.context, self.n, self.at_once = spark.sparkContext, len(rows), at_once
        self.rows = self.context.broadcast(rows)
        self.top, self.s = 1.0, None
        self.top = max(max(self._each(lambda d2, at, sent: float(d2.max()), None)), 1e-300)
        degree = self._product(np.ones(self.n))
        self.s = np.where(degree > 1e-8, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)

    def _each(self, work: Callable, sent) -> list:
        rows, held, at_once, n = self.rows, self.context.broadcast(sent), self.at_once, self.n

        def one(s: int):
            at, all_rows = np.arange(s, min(s + at_once, n)), rows.value
            square = np.einsum("nd,nd->n", all_rows, all_rows)
            return work(np.maximum(square[at, None] + square[None] - 2 * all_rows[at] @ all_rows.T, 0), at, held.value)

        starts = range(0, n, at_once)
        out = self.context.parallelize(starts, min(len(starts), 4 * self.context.defaultParallelism)).map(one).collect()
        held.destroy()
        return out

    def _product(self, x: np.ndarray) -> np.ndarray:
        top = self.top

        def work(d2: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
            near = np.exp(-d2 / top)
            near[np.arange(len(at)), at] = 0.0
            return near @ x

        return np.concatenate(self._each(work, x))

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.s * self._product(self.s * x)

    def close(self) -> None:
        self.rows.destroy()
