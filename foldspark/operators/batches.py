"""Batches for training an encoder on a graph's edges, and their losses, as tables.

An edge is a row (src, dst, e), e being its number among the edges of its source.
Which batch of an epoch it is in, and its negatives, are draws of (src, e), so any
task makes the same batch from its own edges, and nothing is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_column
from .epochs import with_ends

#: Draw numbers of the batch an edge is in, beyond those of its negatives.
WHICH = 1 << 20
SAFE, EDGE = 1e-6, 1e-7
TINY = 1e-8


def training_edges(graph: DataFrame) -> DataFrame:
    """(src, dst, e) of every edge in either direction; e counts from 0 within src, by dst."""
    number = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    return graph.select(F.col("i").alias("src"), F.col("j").alias("dst"), number.cast("long").alias("e"))


def batch(edges: DataFrame, n: int, epoch: int, which: int, n_batches: int, negatives: int = 5, seed: int = 42) -> DataFrame:
    """(src, dst, target) of one batch of an epoch: its edges with target 1, and for each of them ``negatives`` draws among nodes 0 .. n - 1 with target 0, the source itself left out."""
    mine = edges.where(draw_column(seed, F.col("src"), F.lit(epoch), F.col("e"), F.lit(WHICH), n_batches) == which)
    slots = F.explode(F.sequence(F.lit(-1), F.lit(negatives - 1)))
    each = mine.select("src", "dst", "e", slots.alias("m"))
    drawn = each.select("src", "m", F.when(F.col("m") < 0, F.col("dst")).otherwise(draw_column(seed, F.col("src"), F.lit(epoch), F.col("e"), F.greatest("m", F.lit(0)), n)).alias("dst"))
    return drawn.where((F.col("m") < 0) | (F.col("src") != F.col("dst"))).select("src", "dst", F.when(F.col("m") < 0, 1.0).otherwise(0.0).alias("target"))


def cross_entropy(d2: Column, target: Column, a: float, b: float) -> Column:
    """-(t ln q + (1 - t) ln(1 - q)) of q = 1 / (1 + a (d2 + 1e-6)^b), q within 1e-7 of 0 and 1."""
    q = F.least(F.greatest(1.0 / (1.0 + a * F.pow(d2 + SAFE, F.lit(b))), F.lit(EDGE)), F.lit(1.0 - EDGE))
    return -(target * F.ln(q) + (1.0 - target) * F.ln(1.0 - q))


def losses(rows: DataFrame, positions: DataFrame, matrix: DataFrame, a: float, b: float, weight: float = 0.0) -> DataFrame:
    """One row (cross_entropy, correlation, loss, n) of a batch (src, dst, target) at positions (id, x, y).

    ``correlation`` is less the Pearson correlation of the distances of both ends in
    the features and in the layout; ``loss`` is the sum, it being weighted.
    """
    ends = with_ends(rows.select(F.col("src").alias("i"), F.col("dst").alias("j"), "target"), positions)
    u, v = matrix.select(F.col("id").alias("i"), F.col("features").alias("u")), matrix.select(F.col("id").alias("j"), F.col("features").alias("v"))
    far = F.sqrt(F.aggregate(F.zip_with("u", "v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t) + TINY)
    both = ends.join(u, "i").join(v, "j").select(cross_entropy(F.col("d2"), F.col("target"), a, b).alias("ce"), far.alias("x"), F.sqrt(F.col("d2") + TINY).alias("z"))
    one = both.agg(F.avg("ce").alias("cross_entropy"), F.covar_pop("x", "z").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("z").alias("vz"), F.count(F.lit(1)).alias("n"))
    correlation = -F.col("c") / (F.sqrt(F.col("vx") + TINY / F.col("n")) * F.sqrt(F.col("vz") + TINY / F.col("n")))
    return one.select("cross_entropy", correlation.alias("correlation"), (F.col("cross_entropy") + weight * correlation).alias("loss"), "n")
