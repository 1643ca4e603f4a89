"""Graph algebra on edge tables (i long, j long, w double).

The layout of a sparse matrix (by rows or by columns) is a choice of
partitioning here, so conversions between layouts have no operator of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnknownOption
from ..materialize import discard, materialize
from . import powers

EPSILON = 2.220446049250313e-16


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def mirrored(edges: DataFrame, *more: Column, back: tuple[Column, ...] | None = None) -> DataFrame:
    """(i, j, more) of every edge, and (j, i, back or more): both in one scan."""
    there = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), *more)
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *(more if back is None else back))
    return edges.select(F.explode(F.array(there, mirror)).alias("__e")).select("__e.*")


def last_wins(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each (i, j): of several the one last in column ``order``, which isn't kept."""
    return edges.groupBy("i", "j").agg(F.max_by("w", order).alias("w"))


def symmetrise(edges: DataFrame, combine: Callable[[Column, Column], Column], least: float = 0.0) -> DataFrame:
    """combine(w_ij, w_ji) of every pair that has either; an absent one is 0. Values must exceed ``least``.

    One scan and one shuffle: every edge gives itself and its mirror, grouped by
    (i, j). (i, j) must be unique (``last_wins`` makes it so).
    """
    zero = F.lit(0.0)
    both = mirrored(edges, F.col("w").alias("a"), zero.alias("b"), back=(zero.alias("a"), F.col("w").alias("b")))
    merged = both.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return merged.select("i", "j", combine(F.col("a"), F.col("b")).alias("w")).where(F.col("w") > least)


def fuzzy_union(edges: DataFrame, mix: float = 1.0) -> DataFrame:
    """mix (a + b - a b) + (1 - mix) a."""
    return symmetrise(edges, lambda a, b: F.lit(mix) * (a + b - a * b) + F.lit(1.0 - mix) * a)


def joint_probabilities(edges: DataFrame, n: int) -> DataFrame:
    """(p_ij + p_ji) / 2n."""
    return symmetrise(edges, lambda a, b: (a + b) * F.lit(1.0 / (2.0 * n)))


def mean_of_both(edges: DataFrame) -> DataFrame:
    return symmetrise(edges, lambda a, b: (a + b) / 2)


def product_of_both(edges: DataFrame) -> DataFrame:
    return symmetrise(edges, lambda a, b: a * b)


def mutual(edges: DataFrame, theta: float = 1.0) -> DataFrame:
    """theta min + (1 - theta) max, above machine epsilon."""
    return symmetrise(edges, lambda a, b: F.lit(theta) * F.least(a, b) + F.lit(1.0 - theta) * F.greatest(a, b), EPSILON)


SYMMETRIES = {"additive": mean_of_both, "add": mean_of_both, "average": mean_of_both, "multiplicative": product_of_both, "mult": product_of_both, "multiply": product_of_both, "mnn": mutual, "none": lambda e: e}


def symmetrise_as(edges: DataFrame, name: str) -> DataFrame:
    if name.lower() not in SYMMETRIES:
        raise UnknownOption(f"no symmetrisation {name!r}; there are {sorted(SYMMETRIES)}")
    return SYMMETRIES[name.lower()](edges)


def prune(edges: DataFrame, n_epochs: int) -> DataFrame:
    """Edges of at least max(w) / n_epochs: weaker ones would never be sampled. The maximum is one broadcast row; the edges are read twice."""
    top = edges.agg(F.max("w").alias("__top"))
    return edges.crossJoin(F.broadcast(top)).where(F.col("w") >= F.col("__top") / n_epochs).drop("__top")


def degree(edges: DataFrame) -> DataFrame:
    """(i, degree, n_edges)."""
    return edges.groupBy("i").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("n_edges"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, neighbours array<struct<j, w>>), by j."""
    return edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("neighbours"))


def normalise_rows(edges: DataFrame) -> DataFrame:
    """w over the sum of its row; rows of sum 0 stay."""
    total = F.sum("w").over(Window.partitionBy("i"))
    return edges.select("i", "j", F.when(total > 0, F.col("w") / total).otherwise(F.col("w")).alias("w"))


def scale_by_degrees(edges: DataFrame, power: float, negative: bool = False, least: float = 0.0) -> DataFrame:
    """w / (d_i d_j) ** power; 0 where a degree is at most ``least``."""
    d = edges.groupBy("i").agg(F.sum("w").alias("d")).select(F.col("i").alias("node"), F.when(F.col("d") > least, F.pow("d", F.lit(power))).alias("s"))
    a, b = d.toDF("i", "si"), d.toDF("j", "sj")
    both = F.col("si") * F.col("sj")
    w = F.coalesce(F.when(both > 0, F.col("w") / both), F.lit(0.0))
    return edges.join(a, "i", "left").join(b, "j", "left").select("i", "j", (-w if negative else w).alias("w"))


def anisotropic(edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """k_ij / (q_i q_j) ** alpha."""
    return edges if abs(alpha) < EPSILON else scale_by_degrees(edges, alpha)


def symmetric_operator(edges: DataFrame) -> DataFrame:
    """k_ij / sqrt(d_i d_j)."""
    return scale_by_degrees(edges, 0.5)


def negative_normalised_adjacency(edges: DataFrame) -> DataFrame:
    """-w / sqrt(d_i d_j) off the diagonal; degrees of at most 1e-8 count as none."""
    return scale_by_degrees(edges, 0.5, negative=True, least=1e-8).where("i <> j")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product: a join on the inner index, then partial sums by (i, j)."""
    left = a.select(F.col("i").alias("i"), F.col("j").alias("__m"), F.col("w").alias("__a"))
    right = b.select(F.col("i").alias("__m"), F.col("j").alias("j"), F.col("w").alias("__b"))
    return left.join(right, "__m").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("w"))


def power(edges: DataFrame, t: int) -> DataFrame:
    """edges ** t by repeated products with the sparse factor: its square fills up, itself doesn't. By blocks (``powers``); ``discard`` deletes what it reads."""
    if t < 1:
        raise ValueError("the power must be at least 1")
    return edges if t == 1 else powers.power(edges, t)


def sum_of_rows(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(j, w): the sum of the given rows (column i)."""
    return edges.join(rows.select("i").distinct(), "i", "left_semi").groupBy("j").agg(F.sum("w").alias("w"))


def to_dense(edges: DataFrame, ids: list[int]) -> DataFrame:
    """(i, row array<double>) over the given columns; for the small matrices that dense algebra is for."""
    held = edges.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
    return held.select("i", F.transform(F.lit(ids), lambda j: F.coalesce(F.element_at("m", j.cast("long")), F.lit(0.0))).alias("row"))


def dense_entries(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(i, k, w): every row of edges over all nodes by their numbers k; ``places`` is (id, place), consecutive from 0.

    A row is spread where it is written out, a part at a time: nothing holds a list of all nodes.
    """
    n = places.count()
    held = edges.join(places.toDF("j", "k"), "j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("r")).select("i", F.col("r.k").alias("ks"), F.col("r.w").alias("ws"))
    # As many rows come out of each as there are nodes, so few go into a task.
    tasks = edges.sparkSession.sparkContext.defaultParallelism * 4

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ks, ws in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                ks, ws = ks.values.to_numpy(zero_copy_only=False), ws.values.to_numpy(zero_copy_only=False)
                for s in range(0, n, 1 << 18):
                    e = min(s + (1 << 18), n)
                    row, (a, z) = np.zeros(e - s), np.searchsorted(ks, [s, e])
                    row[ks[a:z] - s] = ws[a:z]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, i, np.int64)), pa.array(np.arange(s, e, dtype=np.int32)), pa.array(row)], names=["i", "k", "w"])

    return held.repartition(tasks, "i").mapInArrow(spread, "i long, k int, w double")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(i, component): the least id that a node reaches, edges taken both ways.

    Labels take the least label around them, then the label of their label, so
    rounds grow with the logarithm of a chain's length. Each round is written.
    """
    both = materialize(mirrored(edges).where("i <> j").distinct(), "components-edges")
    now = materialize(nodes.select("i", F.col("i").alias("component")), "components")
    for _ in range(max_rounds):
        around = both.join(now.select(F.col("i").alias("j"), "component"), "j").groupBy("i").agg(F.min("component").alias("least"))
        lower = now.join(around, "i", "left").select("i", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        jump = lower.select(F.col("i").alias("next"), F.col("next").alias("further"))
        after = materialize(lower.join(jump, "next").select("i", F.least("next", "further").alias("component")), "components")
        changed = not after.join(now, ["i", "component"], "left_anti").isEmpty()
        discard(now)
        now = after
        if not changed:
            discard(both)
            return now
    raise RuntimeError("components did not settle")


def within_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, i, j, w) of the edges whose ends share a component."""
    a, b = labels.toDF("i", "component"), labels.toDF("j", "other")
    return edges.join(a, "i").join(b, "j").where("component = other").select("component", "i", "j", "w")


def unweighted(knn: DataFrame) -> DataFrame:
    """A neighbour table as edges of weight 1."""
    return knn.where("i <> j").select("i", "j", F.lit(1.0).alias("w"))


def part_means(matrix: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, p, x): the mean of each dimension p over the rows of each part; ``parts`` is (id, part)."""
    return matrix.join(parts, "id").select("part", F.posexplode("features").alias("p", "x")).groupBy("part", "p").agg(F.avg("x").alias("x"))
