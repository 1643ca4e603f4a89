"""Single epochs of the layouts as relational steps, from positions (id, x, y).

An edge table meets the positions of both its ends and is summed by node. They
serve for layouts too large for one task (see plans.distributed) and give every
gradient a SQL twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_column
from ..functions.layout_tsne import Grid
from .edges import EPSILON, mirrored

CLIP = 4.0
SMALL = 0.001


def with_ends(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds dx, dy (i minus j) and d2."""
    a = positions.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = positions.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    out = edges.join(a, "i").join(b, "j").withColumn("dx", F.col("xi") - F.col("xj")).withColumn("dy", F.col("yi") - F.col("yj"))
    return out.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).drop("xi", "yi", "xj", "yj")


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-CLIP)), F.lit(CLIP))


def umap_schedule(graph: DataFrame) -> DataFrame:
    """Undirected edges i < j numbered by (i, j) within i, with their epochs per sample: max(w) / w."""
    once = graph.where("i < j")
    top = F.broadcast(once.agg(F.max("w").alias("top")))
    number = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    return once.crossJoin(top).select("i", "j", "w", number.alias("e"), F.when(F.col("w") > 0, F.lit(1.0) / (F.col("w") / F.col("top"))).otherwise(1e8).alias("period"))


def due(schedule: DataFrame, epoch: int) -> DataFrame:
    """Edges sampled in this epoch. An edge is due first at its period, then every period: the k-th time in the first epoch at or after k periods."""
    before = F.floor(F.lit(float(epoch - 1)) / F.col("period"))
    return schedule.where(F.floor(F.lit(float(epoch)) / F.col("period")) > before if epoch > 0 else F.lit(False))


#: Added to an edge's number for the draws of its larger end.
OTHER_END = 1 << 20


def negative_slots(now: DataFrame, negatives: int, both_ends: bool = False) -> DataFrame:
    """(i, e, m): a slot for each negative of the smaller end of due edges, or of either end."""
    at = now.select("i", F.col("e").cast("long").alias("e"))
    if both_ends:
        own, other = F.struct(F.col("i").alias("i"), F.col("e").cast("long").alias("e")), F.struct(F.col("j").alias("i"), (F.col("e") + OTHER_END).cast("long").alias("e"))
        at = now.select(F.explode(F.array(own, other)).alias("s")).select("s.i", "s.e")
    return at.select("i", "e", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("m"))


def gradient_norm(gradient: DataFrame) -> DataFrame:
    """One row: the length of the whole gradient (gx, gy)."""
    return gradient.agg(F.sqrt(F.sum(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("norm"))


def umap_gradient(schedule: DataFrame, positions: DataFrame, n: int, epoch: int, a: float, b: float, gamma: float = 1.0, negatives: int = 5, seed: int = 42, both_ends: bool = False) -> DataFrame:
    """(id, gx, gy, n_active): attraction along due edges at both ends, doubled, and hashed negatives of the smaller end, or of either."""
    now = due(schedule, epoch)
    ends = with_ends(mirrored(now), positions)
    pull = F.when(F.col("d2") >= 1e-8, 2.0 * (2.0 * a * b) * F.pow("d2", F.lit(b)) / (F.col("d2") * (1.0 + a * F.pow("d2", F.lit(b))))).otherwise(0.0)
    attract = ends.select(F.col("i").alias("id"), (-pull * F.col("dx")).alias("gx"), (-pull * F.col("dy")).alias("gy"), F.lit(1).alias("active"))
    drawn = negative_slots(now, negatives, both_ends)
    drawn = drawn.select("i", draw_column(seed, F.col("i"), F.lit(epoch), F.col("e"), F.col("m"), n).alias("j")).where("i <> j")
    far = with_ends(drawn, positions)
    safe = F.col("d2") + SMALL
    push = _clip(F.lit(2.0 * gamma * b) / (safe * (1.0 + a * F.pow(safe, F.lit(b)))))
    repel = far.select(F.col("i").alias("id"), (push * F.col("dx")).alias("gx"), (push * F.col("dy")).alias("gy"), F.lit(0).alias("active"))
    return attract.union(repel).groupBy("id").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.sum("active").alias("n_active"))


def tsne_attraction(graph: DataFrame, positions: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """(id, ax, ay): sum of p q (y_i - y_j)."""
    ends = with_ends(graph, positions)
    force = F.col("w") * exaggeration * (F.lit(1.0) / (F.lit(1.0) + F.col("d2")))
    return ends.groupBy(F.col("i").alias("id")).agg(F.sum(force * F.col("dx")).alias("ax"), F.sum(force * F.col("dy")).alias("ay"))


def tsne_repulsion_exact(positions: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(id, rx, ry, z): sums of q^2 (y_i - y_j) and of q over all other points.

    Blocks of positions stream past each other: a task holds two blocks, and no
    side is broadcast. The work is that of all pairs; ``tsne_repulsion_grid``
    stands for it beyond.
    """
    n_blocks = max(1, -(-positions.count() // block_rows))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"b": rows["b"].iloc[:1], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "v": [rows[["x", "y"]].to_numpy(float).tobytes()]})

    blocks = positions.select("id", "x", "y", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b")).groupBy("b").applyInPandas(block, "b int, ids binary, v binary")
    # Each block goes to every task once, its own first: kind 0 opens a block, kind 1 streams past it.
    sent = blocks.select(F.explode(F.concat(F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("kind"))), F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda t: F.struct(t.alias("to"), F.lit(1).alias("kind"))))).alias("s"), "ids", "v")
    sent = sent.select("s.to", "s.kind", "ids", "v").repartition(n_blocks, "to").sortWithinPartitions("to", "kind")

    def repel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = at = sums = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(sums[:, k].copy()) for k in range(3))], names=["id", "rx", "ry", "z"])

        for b in batches:
            for kind, raw, body in zip(*(c.to_pylist() for c in b.columns[1:])):
                other, w = np.frombuffer(raw, np.int64), np.frombuffer(body).reshape(-1, 2)
                if kind == 0:
                    if ids is not None:
                        yield done()
                    ids, at, sums = other, w, np.zeros((len(other), 3))
                    continue
                for s in range(0, len(ids), 1024):
                    dx, dy = (at[s : s + 1024, None, k] - w[None, :, k] for k in (0, 1))
                    q = 1 / (1 + dx * dx + dy * dy)
                    q[ids[s : s + 1024, None] == other[None, :]] = 0
                    sums[s : s + 1024] += np.stack([(q * q * dx).sum(1), (q * q * dy).sum(1), q.sum(1)], 1)
        if ids is not None:
            yield done()

    return sent.mapInArrow(repel, "id long, rx double, ry double, z double")


def tsne_repulsion_grid(positions: DataFrame, nodes: int = 3) -> DataFrame:
    """(id, rx, ry, z) by interpolation on a grid: work in proportion to the points.

    ``positions`` is written: it is read three times. Each partition sums its
    charges; only the grid, of bounded size, reaches the driver, which convolves
    it, and goes back as a broadcast.
    """
    b = positions.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    grid = Grid(np.array(b[:2], float), max(b[2] - b[0], b[3] - b[1]) or 1.0, nodes)

    def charge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((4, grid.size * grid.size))
        for p in batches:
            if len(p):
                held += grid.spread(p[["x", "y"]].to_numpy(float))
        at = np.flatnonzero(np.abs(held).sum(0))
        yield pd.DataFrame({"at": at, **{f"c{k}": held[k, at] for k in range(4)}})

    sums = positions.select("x", "y").mapInPandas(charge, "at long, c0 double, c1 double, c2 double, c3 double").groupBy("at").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]).toPandas()
    held = np.zeros((4, grid.size * grid.size))
    held[:, sums["at"]] = sums[[f"c{k}" for k in range(4)]].to_numpy().T
    felt = positions.sparkSession.sparkContext.broadcast(grid.felt(held))

    def feel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                force, z = grid.gather(p[["x", "y"]].to_numpy(float), felt.value)
                yield pd.DataFrame({"id": p["id"], "rx": force[:, 0], "ry": force[:, 1], "z": z})

    return positions.select("id", "x", "y").mapInPandas(feel, "id long, rx double, ry double, z double")


def tsne_gradient(graph: DataFrame, positions: DataFrame, exaggeration: float = 1.0, repulsion=None) -> DataFrame:
    """(id, gx, gy): attraction less repulsion (``tsne_repulsion_exact`` unless given) over the whole sum of q."""
    repel = (repulsion or tsne_repulsion_exact)(positions)
    total = F.broadcast(repel.agg(F.sum("z").alias("total")))
    both = repel.join(tsne_attraction(graph, positions, exaggeration), "id", "left").crossJoin(total)
    return both.select("id", (F.coalesce("ax", F.lit(0.0)) - F.col("rx") / F.col("total")).alias("gx"), (F.coalesce("ay", F.lit(0.0)) - F.col("ry") / F.col("total")).alias("gy"))


def phase_weights(epoch: int, first: int = 100, second: int = 200) -> tuple[float, float, float]:
    """PaCMAP's weights of near, mid-near and further pairs."""
    if epoch < first:
        at = epoch / first
        return 2.0, 1000.0 * (1 - at) + 3.0 * at, 1.0
    return (3.0, 3.0, 1.0) if epoch < second else (1.0, 0.0, 1.0)


def pacmap_gradient(pairs: DataFrame, positions: DataFrame, epoch: int, first: int = 100, second: int = 200) -> DataFrame:
    """(id, gx, gy): the direction of the step, both ends of every pair (kind, i, j)."""
    near, mid, far = phase_weights(epoch, first, second)
    ends = with_ends(mirrored(pairs, F.col("kind").alias("kind")), positions)

    def pull(weight: float, c: float) -> Column:
        return F.lit(-weight * 2.0 * c) / ((c + (1.0 + F.col("d2"))) * (c + (1.0 + F.col("d2"))))

    push = F.lit(far * 2.0) / ((1.0 + (1.0 + F.col("d2"))) * (1.0 + (1.0 + F.col("d2"))))
    g = F.when(F.col("kind") == "near", pull(near, 10.0)).when(F.col("kind") == "mid_near", pull(mid, 10000.0)).otherwise(push)
    return ends.groupBy(F.col("i").alias("id")).agg(F.sum(g * F.col("dx")).alias("gx"), F.sum(g * F.col("dy")).alias("gy"))


def umap_radii(graph: DataFrame, positions: DataFrame, a: float, b: float) -> DataFrame:
    """(id, re, phi_sum): log radii in the embedding, by the kernel 1 / (1 + a d^2b)."""
    ends = with_ends(graph.select("i", "j"), positions)
    phi = F.lit(1.0) / (1.0 + a * F.pow("d2", F.lit(b)))
    sums = ends.groupBy(F.col("i").alias("id")).agg(F.sum(phi * F.col("d2")).alias("num"), F.sum(phi).alias("phi_sum"))
    return sums.select("id", F.ln(F.lit(1e-8) + F.col("num") / F.greatest("phi_sum", F.lit(EPSILON))).alias("re"), "phi_sum")


def density_weights(radii: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, re, phi_sum, weight): how the correlation of log radii changes with a node's own, from (id, re, phi_sum, r) and one row of mean, std and cov."""
    weight = F.col("r") - F.col("cov") * (F.col("re") - F.col("mean")) / (F.col("std") * F.col("std"))
    return radii.crossJoin(F.broadcast(stats)).select("id", "re", "phi_sum", weight.alias("weight"))


def umap_density_gradient(now: DataFrame, positions: DataFrame, weights: DataFrame, scale: DataFrame, a: float, b: float) -> DataFrame:
    """(id, gx, gy) of densMAP's density term along due edges (i, j, w), at both ends.

    ``weights`` as ``density_weights`` gives them; ``scale``: one row, the share of
    the term over the radii's deviation (``density_scale``).
    """
    held = weights.select("id", "weight", F.greatest("phi_sum", F.lit(EPSILON)).alias("phi"), F.exp(-F.col("re")).alias("inv"))
    ends = with_ends(now.select("i", "j", "w"), positions).join(held.toDF("i", "wi", "pi", "vi"), "i").join(held.toDF("j", "wj", "pj", "vj"), "j")
    power = F.pow("d2", F.lit(b))
    phi = 1.0 / (1.0 + a * power)
    ends = ends.where("d2 >= 1e-8").withColumn("phi", phi).withColumn("slope", a * b * power / F.col("d2") * F.col("phi")).withColumn("common", 1.0 - b * (1.0 - F.col("phi")))
    share = [F.col(f"w{k}") * (F.col("phi") / F.col(f"p{k}") * (F.col("common") * F.col(f"v{k}") + F.col("slope"))) for k in "ij"]
    two = ends.crossJoin(F.broadcast(scale)).withColumn("two", 2.0 * F.col("scale") * (share[0] + share[1]) / F.greatest("w", F.lit(EPSILON)))
    moved = two.select("i", "j", *[(2.0 * _clip(F.col("two") * F.col(f"d{c}"))).alias(f"g{c}") for c in "xy"])
    both = mirrored(moved, F.col("gx").alias("gx"), F.col("gy").alias("gy"), back=((-F.col("gx")).alias("gx"), (-F.col("gy")).alias("gy")))
    return both.groupBy(F.col("i").alias("id")).agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))


def density_scale(original: DataFrame, stats: DataFrame, density: float) -> DataFrame:
    """One row: density * (half the sum of mu) / (std (n - 1)), from (mu_sum) of all nodes and the row of stats."""
    mu = original.agg((F.sum("mu_sum") / 2).alias("mu"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n"))
    return mu.crossJoin(F.broadcast(stats)).select((F.lit(float(density)) * F.col("mu") / (F.col("std") * F.col("n"))).alias("scale"))


def pacmap_pairs(knn: DataFrame, n: int, near: int = 10, mid: int = 5, further: int = 20, start: int = 4, end: int = 50, seed: int = 42) -> DataFrame:
    """(kind, i, j). Near: the first neighbours. Mid-near: the first of the window from ``start``. Further: hashed draws of nodes.

    Nodes must be 0 .. n - 1. Where a list ends before the window starts, mid-near
    pairs are hashed draws from it. A draw of the node itself is drawn again, up
    to ten times for each pair asked for.
    """
    short = knn.groupBy("i").agg(F.count(F.lit(1)).alias("width"))
    at = knn.join(short, "i")
    close = at.where(F.col("rank") <= near).select(F.lit("near").alias("kind"), "i", "j")
    window = at.where((F.col("rank") > start) & (F.col("rank") <= start + mid) & (F.col("rank") <= end)).select(F.lit("mid_near").alias("kind"), "i", "j")
    slots = short.where(F.least("width", F.lit(end)) <= start).select("i", "width", F.explode(F.sequence(F.lit(0), F.lit(max(mid - 1, 0)))).alias("m")).where(F.col("m") < F.least("width", F.lit(end)))
    picked = slots.withColumn("rank", (F.pmod(draw_column(seed + 1, F.col("i"), F.lit(0), F.col("m"), F.lit(0), 1 << 31), F.least("width", F.lit(end))) + 1).cast("int"))
    window = window.unionByName(picked.join(knn, ["i", "rank"]).select(F.lit("mid_near").alias("kind"), "i", "j"))
    # Exploded before drawing, so the draws are code-generated. Of a node's draws only those of itself are made again, which few nodes need.
    def tries(nodes: DataFrame, first: int, last: int) -> DataFrame:
        return nodes.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("m")).withColumn("j", draw_column(seed, F.col("i"), F.lit(0), F.lit(0), F.col("m"), n))

    drawn = tries(short.select("i"), 0, further - 1)
    lacking = drawn.where("j = i").groupBy("i").agg(F.count(F.lit(1)).alias("lacks"))
    again = tries(lacking, further, 10 * further - 1).where("j <> i").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("m"))).where("r <= lacks")
    far = drawn.where("j <> i").select("i", "j").union(again.select("i", "j")).select(F.lit("further").alias("kind"), "i", "j")
    return close.unionByName(window).unionByName(far)


def tsne_radii(graph: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, re, phi_sum): log radii in the embedding, by the kernel 1 / (1 + d^2)."""
    return umap_radii(graph, positions, 1.0, 1.0)


def densne_gradient(graph: DataFrame, positions: DataFrame, radii: DataFrame, stats: DataFrame, weight: float = 0.1) -> DataFrame:
    """(id, gx, gy) of the density term, to be taken off the gradient.

    ``radii``: (id, re, phi_sum, r). ``stats``: one row of mean, std and cov.
    """
    n = F.broadcast(radii.agg(F.count(F.lit(1)).alias("n")))
    share = (F.col("r") / F.col("std") - F.col("cov") / F.pow("std", F.lit(3.0)) * (F.col("re") - F.col("mean"))) * (1.0 + F.exp(-F.col("re"))) / F.greatest("phi_sum", F.lit(EPSILON))
    held = radii.crossJoin(F.broadcast(stats)).select("id", share.alias("s"))
    ends = with_ends(graph.select("i", "j"), positions).join(held.toDF("i", "si"), "i").join(held.toDF("j", "sj"), "j")
    phi = 1.0 / (1.0 + F.col("d2"))
    g = phi * phi * (F.col("si") + F.col("sj"))
    sums = ends.groupBy(F.col("i").alias("id")).agg(F.sum(g * F.col("dx")).alias("gx"), F.sum(g * F.col("dy")).alias("gy"))
    scale = F.lit(float(weight)) / F.greatest(F.col("n") - 1, F.lit(1))
    return sums.crossJoin(n).select("id", (F.col("gx") * scale).alias("gx"), (F.col("gy") * scale).alias("gy"))


def tsne_step(state: DataFrame, gradient: DataFrame, lr: float, momentum: float) -> DataFrame:
    """One step of (id, x, y, ux, uy, wx, wy): gains, momentum, the cap on a step, and centring. One row of means is broadcast."""
    s = state.join(gradient, "id")
    for c in "xy":
        gain = F.greatest(F.when((F.col(f"g{c}") > 0) != (F.col(f"u{c}") > 0), F.col(f"w{c}") + 0.2).otherwise(F.col(f"w{c}") * 0.8), F.lit(0.01))
        s = s.withColumn(f"w{c}", gain).withColumn(f"u{c}", momentum * F.col(f"u{c}") - lr * F.col(f"w{c}") * F.col(f"g{c}"))
    cap = max(0.025 * lr, 5.0)
    size = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"))
    scale = F.when(size > cap, cap / size).otherwise(1.0)
    s = s.withColumn("__k", scale)
    moved = s.select("id", *[(F.col(c) + F.col(f"u{c}") * F.col("__k")).alias(c) for c in "xy"], *[(F.col(f"u{c}") * F.col("__k")).alias(f"u{c}") for c in "xy"], "wx", "wy")
    mean = F.broadcast(moved.agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my")))
    return moved.crossJoin(mean).select("id", (F.col("x") - F.col("__mx")).alias("x"), (F.col("y") - F.col("__my")).alias("y"), "ux", "uy", "wx", "wy")


def umap_loss(pairs: DataFrame, positions: DataFrame, a: float, b: float) -> DataFrame:
    """One row: the mean cross-entropy of q = 1 / (1 + a (d2 + 1e-6)^b) with (i, j, target)."""
    ends = with_ends(pairs.select("i", "j", "target"), positions)
    q = F.least(F.greatest(1.0 / (1.0 + a * F.pow(F.col("d2") + 1e-6, F.lit(b))), F.lit(1e-7)), F.lit(1.0 - 1e-7))
    return ends.agg(F.avg(-(F.col("target") * F.ln(q) + (1.0 - F.col("target")) * F.ln(1.0 - q))).alias("loss"), F.count(F.lit(1)).alias("n"))
