"""Synthetic matrices: (id, features, ...), made in parallel from hashes of seed and id, so they don't depend on partitioning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownOption, WrongDimensions
from ..functions.hashing import normals


def uniform(seed: int, *tags: Column | int | str) -> Column:
    """A number in [0, 1) of the seed and tags."""
    parts = [F.lit(t) if not isinstance(t, Column) else t for t in (seed, *tags)]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *tags) -> Column:
    """A standard normal draw, by the Box-Muller transform of two uniform ones."""
    u = F.greatest(uniform(seed, *tags, "u"), F.lit(1e-300))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * uniform(seed, *tags, "v"))


def swiss_roll(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 42, bias: float = 1.0) -> DataFrame:
    """A rolled sheet in three dimensions and its arc parameter t; a bias other than 1 makes its density uneven."""
    t = F.lit(1.5 * math.pi) * (1.0 + 2.0 * F.pow(uniform(seed, F.col("id"), "t"), F.lit(bias)))
    shake = [(2.0 * uniform(seed, F.col("id"), f"n{k}") - 1.0) * noise for k in range(3)]
    rolled = spark.range(n).withColumn("t", t)
    return rolled.select("id", F.array(F.col("t") * F.cos("t") + shake[0], 21.0 * uniform(seed, F.col("id"), "h") + shake[1], F.col("t") * F.sin("t") + shake[2]).alias("features"), "t")


def _blobs(spark: SparkSession, n: int, centres: np.ndarray, spread: np.ndarray, seed: int, label: Column) -> DataFrame:
    dims = centres.shape[1]
    # Centres and deviations are bounded by the arguments, not by the rows.
    sent = spark.sparkContext.broadcast((centres, spread))

    def draw(batches):
        c, s = sent.value
        for b in batches:
            k = b["label"].to_numpy()
            yield pd.DataFrame({"id": b["id"], "features": list(c[k] + normals(seed, b["id"], dims) * s[k][:, None]), "label": b["label"]})

    return spark.range(n).withColumn("label", label.cast("int")).mapInPandas(draw, "id long, features array<double>, label int")


def clusters(spark: SparkSession, n: int, dims: int = 50, n_clusters: int = 5, seed: int = 42) -> DataFrame:
    """Gaussian blobs of uneven sizes: centres in U(-7.5, 7.5), deviations in U(0.5, 2.5)."""
    rng = np.random.default_rng(seed)
    centres, spread = rng.uniform(-7.5, 7.5, (n_clusters, dims)), rng.uniform(0.5, 2.5, n_clusters)
    edges = np.cumsum(rng.uniform(0.5, 1.5, n_clusters))
    cuts = (edges / edges[-1])[:-1].tolist()
    label = F.lit(0)
    for c in cuts:
        label = label + (F.col("id") >= F.lit(c * n)).cast("int")
    return _blobs(spark, n, centres, spread, seed, label)


def hierarchical(spark: SparkSession, n: int, dims: int = 20, groups: int = 3, subs: int = 3, group_spread: float = 20.0, sub_spread: float = 5.0, std: float = 1.0, seed: int = 42) -> DataFrame:
    """Blobs around sub-centres around centres; rows are cut to a multiple of groups * subs."""
    rng = np.random.default_rng(seed)
    tops = rng.normal(0, group_spread, (groups, dims))
    centres = (tops[:, None] + rng.normal(0, sub_spread, (groups, subs, dims))).reshape(-1, dims)
    each = n // (groups * subs)
    made = _blobs(spark, each * groups * subs, centres, np.full(len(centres), std), seed, F.floor(F.col("id") / max(each, 1)))
    return made.select("id", "features", F.floor(F.col("label") / subs).cast("int").alias("supergroup"), "label")


@dataclass(frozen=True)
class Branch:
    """A branch from a place (0 to 1) along its parent, in units of the trunk's length."""

    parent: int | None
    split_at: float
    length: float


# Parent, place of the split and length of every branch.
TOPOLOGIES: dict[str, tuple[Branch, ...]] = {
    "bifurcation": (Branch(None, 0.0, 0.75), Branch(0, 1.0, 0.5), Branch(1, 1.0, 3.0), Branch(1, 1.0, 1.0), Branch(3, 1.0, 1.5), Branch(3, 1.0, 2.5)),
    "linear": (Branch(None, 0.0, 1.0), Branch(0, 1.0, 2.0), Branch(1, 1.0, 3.0)),
    "combination": (Branch(None, 0.0, 5.0), Branch(0, 0.2, 2.0), Branch(0, 0.5, 2.5), Branch(0, 0.8, 3.0)),
}


def trajectory(spark: SparkSession, n: int, topology: str = "bifurcation", dims: int = 20, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Curved branches, each along its own axis with a bend into the next: (id, features, branch)."""
    if topology.lower() not in TOPOLOGIES:
        raise UnknownOption(f"no topology {topology!r}; there are {sorted(TOPOLOGIES)}")
    branches = TOPOLOGIES[topology.lower()]
    if dims < len(branches):
        raise WrongDimensions(f"{len(branches)} branches need as many dimensions")

    def place(k: int, t: np.ndarray) -> np.ndarray:
        b = branches[k]
        out = np.zeros((len(t), dims))
        if b.parent is not None:
            out += place(b.parent, np.full(1, b.split_at))
        out[:, k] += 10 * b.length * t
        out[:, (k + 1) % dims] += 2 * b.length * np.sin(np.pi * t / 2) ** 2
        return out

    lengths = np.cumsum([b.length for b in branches])

    def walk(batches):
        for f in batches:
            at = (f["id"].to_numpy() + 0.5) / n * lengths[-1]
            k = np.searchsorted(lengths, at)
            t = (at - np.concatenate([[0], lengths])[k]) / np.array([b.length for b in branches])[k]
            x = np.zeros((len(f), dims))
            for b in range(len(branches)):
                x[k == b] = place(b, t[k == b])
            yield pd.DataFrame({"id": f["id"], "features": list(x + noise * normals(seed, f["id"], dims)), "branch": k.astype(np.int32)})

    return spark.range(n).mapInPandas(walk, "id long, features array<double>, branch int")
