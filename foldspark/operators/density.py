"""Local radii in the data and in an embedding, for the density-preserving methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DegenerateRadii
from .edges import EPSILON

OFFSET = 1e-8


def edge_distances(graph: DataFrame, knn: DataFrame, squared: bool = True) -> DataFrame:
    """Adds d2 to the edges: the distance found from i to j, else from j to i, else 0."""
    near = knn.select("i", "j", (F.col("d") if squared else F.col("d") * F.col("d")).alias("d"))
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("e"))
    return graph.join(near, ["i", "j"], "left").join(back, ["i", "j"], "left").select("i", "j", "w", F.coalesce("d", "e", F.lit(0.0)).alias("d2"))


def log_radii(nodes: DataFrame, edges_with_d2: DataFrame) -> DataFrame:
    """(i, log_radius, mu_sum): ln(1e-8 + mean of d2 by weight), for nodes without edges too."""
    sums = edges_with_d2.groupBy("i").agg(F.sum(F.col("w") * F.col("d2")).alias("num"), F.sum("w").alias("mu"))
    held = nodes.select("i").join(sums, "i", "left").select("i", F.coalesce("num", F.lit(0.0)).alias("num"), F.coalesce("mu", F.lit(0.0)).alias("mu_sum"))
    return held.select("i", F.ln(F.lit(OFFSET) + F.col("num") / F.greatest("mu_sum", F.lit(EPSILON))).alias("log_radius"), "mu_sum")


def standardise(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the z-score, by the sample deviation. One row of statistics is broadcast."""
    stats = df.agg(F.avg(column).alias("__mean"), F.stddev_samp(column).alias("__sd"), F.count(F.lit(1)).alias("__n"))
    row = stats.first()
    if row["__n"] < 2 or row["__sd"] is None or not row["__sd"] > EPSILON:
        raise DegenerateRadii("radii have no variance")
    return df.withColumn(to, (F.col(column) - F.lit(row["__mean"])) / F.lit(row["__sd"]))


def original_radii(nodes: DataFrame, graph: DataFrame, knn: DataFrame) -> DataFrame:
    """(i, r, mu_sum): standardised log radii in the data."""
    return standardise(log_radii(nodes, edge_distances(graph, knn)), "log_radius", "r").select("i", "r", "mu_sum")


def correlation_stats(df: DataFrame, embedded: str = "re", original: str = "r", shift: float = 0.1) -> DataFrame:
    """One row: mean of ``embedded``, sqrt(sample variance + shift), and the covariance as sum of (re - mean) r over n - 1."""
    mean = df.agg(F.avg(embedded).alias("__mean"))
    off = F.col(embedded) - F.col("__mean")
    return df.crossJoin(F.broadcast(mean)).agg(
        F.first("__mean").alias("mean"),
        F.sqrt(F.sum(off * off) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1)) + shift).alias("std"),
        (F.sum(off * F.col(original)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("cov"),
    )
