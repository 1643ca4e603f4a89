"""Training of parametric UMAP's encoder over tables, data-parallel.

A round takes one batch of edges and negatives, joins the features of both ends,
and lets every task sum the gradients of its rows; sums are added in groups until
few are left, and the driver makes one Adam step. Weights go out with the next
round; features and the graph never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownOption
from ..functions.curves import fit_ab
from ..functions.mlp import Mlp, umap_loss
from ..materialize import discard, materialize
from ..operators import batches
from ..sources.matrix import shape
from .distributed import _placed, _places
from .params import ParametricParams, UmapParams
from .pipelines import encode, umap_graph

#: Edges of a batch: a round is a few jobs, so it is worth many more rows than a step in one task.
BATCH_EDGES = 65_536
#: Sums that are added at once, and rows of a task that are.
FAN_IN, AT_ONCE = 64, 4096


@dataclass
class Trained:
    net: Mlp
    losses: list[float] = field(default_factory=list)


def _flat(pairs) -> np.ndarray:
    return np.concatenate([p.ravel() for pair in pairs for p in pair])


def gradient(rows: DataFrame, net: Mlp, a: float, b: float) -> tuple[float, int, np.ndarray]:
    """(mean loss, rows, mean gradient of all weights and biases, flat) of a batch (u, v, target) with both ends' features."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        total, loss, n = None, 0.0, 0
        for part in parts:
            for s in range(0, len(part), AT_ONCE):
                x = part.iloc[s : s + AT_ONCE]
                la, lb = (own.layers(np.stack(x[c].to_numpy()).astype(float)) for c in "uv")
                mean, ga, gb = umap_loss(la[-1], lb[-1], x["target"].to_numpy(float), a, b)
                g = _flat([(p[0] + q[0], p[1] + q[1]) for p, q in zip(own.gradients(la, ga), own.gradients(lb, gb))]) * len(x)
                total = g if total is None else total + g
                loss, n = loss + mean * len(x), n + len(x)
        if n:
            yield pd.DataFrame({"loss": [loss], "n": [n], "g": [total.tobytes()]})

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(x) for x in rows.sort_values("at")["g"])
        return pd.DataFrame({"at": rows["to"].iloc[:1].to_numpy(), "loss": [rows["loss"].sum()], "n": [rows["n"].sum()], "g": [g.tobytes()]})

    schema = "loss double, n long, g binary"
    sums = materialize(rows.select("u", "v", "target").mapInPandas(add, schema).select(F.spark_partition_id().cast("long").alias("at"), "*"), "gradients")
    while sums.count() > FAN_IN:
        before, sums = sums, materialize(sums.withColumn("to", F.expr(f"at div {FAN_IN}")).groupBy("to").applyInPandas(stack, f"at long, {schema}"), "gradients")
        discard(before)
    held = sums.orderBy("at").collect()  # at most FAN_IN
    discard(sums)
    n = sum(r["n"] for r in held)
    if not n:
        return 0.0, 0, np.zeros(0)
    return sum(r["loss"] for r in held) / n, n, sum(np.frombuffer(bytes(r["g"])) for r in held) / n


def train(matrix: DataFrame, p: ParametricParams = ParametricParams(), given: DataFrame | None = None, seed: int = 42, rounds: int | None = None, batch_edges: int = BATCH_EDGES) -> Trained:
    """An encoder trained by ``rounds`` Adam steps (default: all batches of all epochs), and the loss of each. The correlation term isn't part of it."""
    if p.correlation:
        raise UnknownOption("the correlation term needs a whole batch in one task; only the trainer in one task has it")
    n, dims = shape(matrix)
    graph, near = umap_graph(matrix, UmapParams(p.n_dim, p.k, p.knn, min_dist=p.min_dist, spread=p.spread, n_epochs=p.n_epochs, prune_epochs=p.prune_epochs), given)
    places = _places(matrix)
    edges = materialize(batches.training_edges(_placed(graph, places, "w")), "training-edges")
    rows = materialize(matrix.join(places, "id").select("place", "features"), "training-rows")
    discard(graph, places, near)
    n_batches = max(1, -(-edges.count() // batch_edges))
    a, b = fit_ab(p.min_dist, p.spread)
    out = Trained(Mlp.start([dims, *p.hidden, p.n_dim], seed))
    first, second = 0.0, 0.0
    u, v = rows.select(F.col("place").alias("src"), F.col("features").alias("u")), rows.select(F.col("place").alias("dst"), F.col("features").alias("v"))
    for t in range(1, 1 + (rounds if rounds is not None else n_batches * p.n_epochs)):
        epoch, which = divmod(t - 1, n_batches)
        drawn = batches.batch(edges, n, epoch, which, n_batches, p.negatives, seed)
        loss, m, g = gradient(drawn.join(u, "src").join(v, "dst"), out.net, a, b)
        if not m:
            continue
        out.losses.append(loss)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = p.lr * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        at = 0
        for pair in zip(out.net.weights, out.net.biases):
            for w in pair:
                w -= step[at : at + w.size].reshape(w.shape)
                at += w.size
    discard(edges, rows)
    return out


def parametric_umap(matrix: DataFrame, p: ParametricParams = ParametricParams(), given: DataFrame | None = None, seed: int = 42, rounds: int | None = None) -> DataFrame:
    """(id, x): the rows through an encoder that ``train`` gives."""
    return encode(matrix, train(matrix, p, given, seed, rounds).net).select("id", "x")
