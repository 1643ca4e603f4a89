"""Affinities from neighbour tables (i, rank, j, d), d being squared if euclidean.

Bandwidth searches are one expression over the sorted distances of a row: a fold
over a fixed number of steps, so a row's search runs inside its task, after one
shuffle by i that gathers the k distances.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NeighboursTooFew
from . import edges as E

STEPS = 64
TOLERANCE = 1e-5
PERPLEXITY_STEPS = 200
EPSILON = E.EPSILON
#: Stands for an upper end that isn't known yet.
OPEN = 1.7976931348623157e308


def neighbour_rows(knn: DataFrame) -> DataFrame:
    """(i, ds, js): distances and neighbours of each row by rank."""
    rows = knn.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d"))).alias("r"))
    return rows.select("i", F.col("r.d").alias("ds"), F.col("r.j").alias("js"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bind(value: Column, then) -> Column:
    """then(value), value being computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def rho_of(ds: Column, local_connectivity: float = 1.0) -> Column:
    """The distance at place local_connectivity, between neighbours if that isn't whole; 0 for none."""
    if local_connectivity <= 0:
        return F.lit(0.0)
    offset = max(local_connectivity - 1.0, 0.0)
    whole, part = int(math.floor(offset)), offset - math.floor(offset)
    at = F.least(F.lit(whole), F.size(ds) - 1)
    here = F.get(ds, at)
    if part > 0:
        here = F.when(at + 1 < F.size(ds), here * (1.0 - part) + F.get(ds, at + 1) * part).otherwise(here)
    return F.coalesce(here, F.lit(0.0))


def smooth_knn(rows: DataFrame, k: int, local_connectivity: float = 1.0, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """Adds rho and sigma: sum of exp(-max(d - rho, 0) / sigma) is ln k, by bisection."""
    target = math.log(k)
    state = F.struct(F.lit(0.0).alias("lo"), F.lit(OPEN).alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))

    def step(s: Column, adjusted: Column) -> Column:
        def moved(total: Column) -> Column:
            found = F.abs(total - target) < tolerance
            high = total > target
            lo = F.when(s["done"] | found | high, s["lo"]).otherwise(s["mid"])
            hi = F.when(~(s["done"] | found) & high, s["mid"]).otherwise(s["hi"])
            mid = F.when(s["done"] | found, s["mid"]).when(high, (s["lo"] + s["mid"]) / 2).when(s["hi"] == OPEN, s["mid"] * 2).otherwise((s["mid"] + s["hi"]) / 2)
            return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), (s["done"] | found).alias("done"))

        total = F.when(s["done"], F.lit(0.0)).otherwise(_bind(F.lit(1.0) / s["mid"], lambda inv: _sum(F.transform(adjusted, lambda a: F.exp(-a * inv)))))
        return _bind(total, moved)

    with_rho = rows.withColumn("rho", rho_of(F.col("ds"), local_connectivity))
    with_rho = with_rho.withColumn("__adjusted", F.transform("ds", lambda d: F.greatest(d - F.col("rho"), F.lit(0.0))))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: step(s, F.col("__adjusted")))
    return with_rho.withColumn("sigma", found["mid"]).drop("__adjusted")


def memberships(smooth: DataFrame) -> DataFrame:
    """Directed edges of weight exp(-max(d - rho, 0) / sigma); with sigma 0, 1 at rho and 0 beyond."""
    pair = smooth.select("i", "rho", "sigma", F.explode(F.arrays_zip("js", "ds")).alias("p"))
    over = F.greatest(F.col("p.ds") - F.col("rho"), F.lit(0.0))
    w = F.when(F.col("sigma") > 0, F.exp(-over * (F.lit(1.0) / F.col("sigma")))).otherwise(F.when(over > 0, 0.0).otherwise(1.0))
    return pair.select("i", F.col("p.js").alias("j"), w.alias("w")).where("i <> j")


def umap_graph(knn: DataFrame, k: int, local_connectivity: float = 1.0, mix: float = 1.0, n_epochs: int | None = 500) -> DataFrame:
    """Neighbours to the symmetric fuzzy graph, without edges too weak to be sampled in n_epochs."""
    graph = E.fuzzy_union(memberships(smooth_knn(neighbour_rows(knn), k, local_connectivity)), mix)
    return E.prune(graph, n_epochs) if n_epochs else graph


def conditional_probabilities(knn: DataFrame, perplexity: float, squared: bool = True, tolerance: float = TOLERANCE, steps: int = PERPLEXITY_STEPS) -> DataFrame:
    """p_j|i of an entropy of log2(perplexity), by bisection on beta.

    Neighbours nearer than machine epsilon get no edge; the sums of the last
    beta that was evaluated normalise, whether or not the search had ended.
    """
    least = knn.groupBy("i").count().agg(F.min("count")).first()[0]
    if least is not None and perplexity >= least:
        raise NeighboursTooFew(f"perplexity {perplexity} needs more than {least} neighbours")
    target = math.log2(perplexity)
    rows = neighbour_rows(knn).withColumn("r", F.filter(F.arrays_zip("js", "ds"), lambda p: p["ds"] >= EPSILON))
    rows = rows.select("i", F.transform("r", lambda p: p["js"]).alias("js"), F.transform("r", lambda p: p["ds"] if squared else p["ds"] * p["ds"]).alias("ds"))
    state = F.struct(F.lit(1.0).alias("beta"), F.lit(-1.0).alias("lo"), F.lit(-1.0).alias("hi"), F.lit(1.0).alias("used"), F.lit(EPSILON).alias("total"), F.lit(False).alias("done"))

    def step(s: Column) -> Column:
        def moved(v: Column) -> Column:
            total = F.when(F.abs(v["p"]) < EPSILON, F.lit(EPSILON)).otherwise(v["p"])
            diff = F.lit(1.4426950408889634) * (F.ln(total) + s["beta"] * v["dp"] / total) - target
            stop = F.abs(diff) < tolerance
            high = diff > 0
            beta = F.when(stop, s["beta"]).when(high, F.when(s["hi"] < 0, s["beta"] * 2).otherwise((s["beta"] + s["hi"]) / 2)).otherwise(F.when(s["lo"] < 0, s["beta"] / 2).otherwise((s["beta"] + s["lo"]) / 2))
            lo = F.when(~stop & high, s["beta"]).otherwise(s["lo"])
            hi = F.when(~stop & ~high, s["beta"]).otherwise(s["hi"])
            return F.struct(beta.alias("beta"), lo.alias("lo"), hi.alias("hi"), s["beta"].alias("used"), total.alias("total"), stop.alias("done"))

        zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("dp"))
        sums = F.aggregate("ds", zero, lambda a, d: _bind(F.exp(-s["beta"] * d), lambda e: F.struct((a["p"] + e).alias("p"), (a["dp"] + d * e).alias("dp"))))
        return F.when(s["done"], s).otherwise(_bind(sums, moved))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: step(s))
    pair = rows.withColumn("s", found).select("i", "s", F.explode(F.arrays_zip("js", "ds")).alias("p"))
    prob = F.exp(-F.col("s.used") * F.col("p.ds")) * (F.lit(1.0) / F.col("s.total"))
    return pair.select("i", F.col("p.js").alias("j"), prob.alias("w")).where((F.col("w") > EPSILON) & (F.col("i") != F.col("j")))


def tsne_graph(knn: DataFrame, perplexity: float, n: int) -> DataFrame:
    return E.joint_probabilities(conditional_probabilities(knn, perplexity), n)


def alpha_decay(knn: DataFrame, k: int, decay: float | None = 40.0, scale: float = 1.0, least: float = 1e-4, symmetry: str = "additive", squared: bool = True) -> DataFrame:
    """exp(-(d / sigma_i) ** decay), sigma_i being scale times the k-th neighbour's distance; binary edges without decay."""
    if decay is None:
        binary = knn.where((F.col("rank") <= k) & (F.col("i") != F.col("j"))).select("i", "j", F.lit(1.0).alias("w"))
        return binary if symmetry == "none" else E.mean_of_both(binary)
    d = F.sqrt("d") if squared else F.col("d")
    rows = neighbour_rows(knn.withColumn("d", d))
    at = F.least(F.lit(k), F.size("ds")) if k > 0 else F.size("ds")
    rows = rows.withColumn("sigma", F.greatest(F.element_at("ds", at.cast("int")) * scale, F.lit(EPSILON)))
    pair = rows.select("i", "sigma", F.explode(F.arrays_zip("js", "ds")).alias("p"))
    near = F.col("p.ds") < (math.sqrt(EPSILON) if squared else EPSILON)
    w = F.when(near, F.lit(1.0)).otherwise(F.exp(-F.pow(F.col("p.ds") / F.col("sigma"), F.lit(float(decay)))))
    directed = pair.select("i", F.col("p.js").alias("j"), w.alias("w"), near.alias("near")).where((F.col("i") != F.col("j")) & (F.col("near") | (F.col("w") >= least)))
    return E.symmetrise_as(directed.drop("near"), symmetry)
