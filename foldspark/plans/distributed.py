"""Layouts without a bound on points, started from tables.

Up to MOST_POINTS points an epoch is a round over blocks of edges that stay with the
executors (``operators.rounds``); the driver holds the layout, not the graph. Beyond,
positions and moments are tables: an epoch joins edges with them, sums by node and
writes the next state to the shared folder, which costs a few jobs an epoch. Both give
the layouts of ``pipelines`` but for the order of sums, where starts and draws are the same.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownOption, WrongDimensions
from ..functions.curves import fit_ab
from ..functions.layout_tsne import TsneOptions
from ..functions.layout_umap import Density, UmapOptions
from ..functions.linalg import knee
from ..materialize import discard, materialize, owning
from ..operators import affinity, barnes_hut, density, edges as E, eigen, epochs, rounds, scaling
from ..operators.rounds import placed as _placed, places as _places
from ..operators.svd import principal_scores
from ..sources.matrix import shape
from ..sources.synthetic import normal, uniform
from .params import DiffusionParams, PacmapParams, PhateParams, TsneParams, UmapParams
from .pipelines import MOST_POINTS, _spectral_part, component_centres, diffusion_maps_operator, edge_blocks, least_gaps, neighbours, phate_operator, tsne_graph

#: Points of a layout by rounds; beyond, an epoch is joins and sums.
ROUNDS_UP_TO = MOST_POINTS


def first_two_axes(matrix: DataFrame, span: float) -> DataFrame:
    """(id, x, y): scores on the first two principal axes, scaled to a deviation of ``span``. Only the covariance reaches the driver."""
    scores = principal_scores(matrix, 2).select("id", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))
    sd = scores.agg(F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    return scores.select("id", *[(F.col(c) * (span / (sd[c] or 1.0))).alias(c) for c in "xy"])


def _state(positions: DataFrame) -> DataFrame:
    return positions.select("id", "x", "y", *[F.lit(0.0).alias(c) for c in ("mx", "my", "vx", "vy")])


def _adam(state: DataFrame, gradient: DataFrame, rate: float, tiny: float, beta1: float, beta2: float, moving: Column) -> DataFrame:
    """One Adam step; nodes that don't move keep their moments."""
    s = state.join(gradient, "id", "left").withColumn("__go", F.coalesce(moving, F.lit(False)))
    for c in "xy":
        g = F.coalesce(F.col(f"g{c}"), F.lit(0.0))
        s = s.withColumn(f"__m{c}", F.col(f"m{c}") + (1 - beta1) * (g - F.col(f"m{c}"))).withColumn(f"__v{c}", F.col(f"v{c}") + (1 - beta2) * (g * g - F.col(f"v{c}")))
    out = {}
    for c in "xy":
        step = rate * F.col(f"__m{c}") / (F.sqrt(f"__v{c}") + tiny)
        out[c] = F.when(F.col("__go"), F.col(c) + step).otherwise(F.col(c))
        for k in "mv":
            out[f"{k}{c}"] = F.when(F.col("__go"), F.col(f"__{k}{c}")).otherwise(F.col(f"{k}{c}"))
    return s.select("id", *[out[c].alias(c) for c in ("x", "y", "mx", "my", "vx", "vy")])


def _xy(state: DataFrame) -> np.ndarray:
    """Positions (id, x, y) by place."""
    rows = rounds.arrays(state.select("id", "x", "y"))
    return np.stack([rows["x"], rows["y"]], axis=1)[np.argsort(rows["id"])]


def _layout(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(id, x, y) of positions by place, written."""
    return materialize(rounds.table(spark, np.arange(len(x)), x).select("id", *[F.get("x", F.lit(c)).alias("xy"[c]) for c in range(2)]), "layout")


def _held(original: DataFrame | None, p) -> Density | None:
    """The radii in the data (i, r, mu_sum) by place."""
    if original is None:
        return None
    rows = rounds.arrays(original)
    return Density(rows["r"][np.argsort(rows["i"])], rows["mu_sum"].sum() / 2, p.density, p.density_share, p.density_shift)


def _result(state: DataFrame, places: DataFrame) -> DataFrame:
    return state.withColumnRenamed("id", "place").join(places, "place").select("id", F.array("x", "y").alias("x"))


#: Components of up to so many nodes are laid out in tasks, some at once; larger ones by the block eigensolver.
SMALL_PART, PACK_NODES = 2000, 20_000


def _own_axes(graph: DataFrame, nodes: DataFrame, seed: int, tolerance: float, rounds: int) -> DataFrame:
    """(id, x, y) of one component: the eigenvectors after the first, written."""
    scaled = materialize(E.scale_by_degrees(graph, 0.5), "spectral-graph")
    found = eigen.extreme_eigenpairs(scaled, nodes, 3, tolerance=tolerance, most_cycles=rounds, seed=seed).vectors
    out = materialize(found.select("id", *[F.coalesce(F.get("v", F.lit(k + 1)), F.lit(0.0)).alias("xy"[k]) for k in range(2)]), "axes")
    discard(scaled, found)
    return out


def _small_axes(graph: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(id, x, y) of many small components (labels: i, component): dealt into groups of about PACK_NODES nodes, each laid out in a task; written."""
    n_packs = max(1, -(-labels.count() // PACK_NODES))
    pack = F.pmod(F.xxhash64("component"), F.lit(n_packs)).cast("int").alias("pack")
    inner = E.within_components(graph, labels)

    def lay(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["component", "i"])
        edges = edges.sort_values(["component", "i", "j"])
        ids, part = nodes["i"].to_numpy(), nodes["component"].to_numpy()
        number, first = np.unique(part, return_index=True)
        cuts = np.searchsorted(edges["component"].to_numpy(), number, side="left"), np.searchsorted(edges["component"].to_numpy(), number, side="right")
        out = np.zeros((len(ids), 2))
        for c, (s, e) in enumerate(zip(first, [*first[1:], len(ids)])):
            mine, own = ids[s:e], edges.iloc[cuts[0][c] : cuts[1][c]]
            i, j = (np.searchsorted(mine, own[k].to_numpy()) for k in "ij")
            out[s:e] = _spectral_part(i, j, own["w"].to_numpy(float), len(mine), 2, seed + int(number[c] % 1_000_003))
        return pd.DataFrame({"id": ids, "x": out[:, 0], "y": out[:, 1]})

    left = labels.select("i", "component", pack)
    right = inner.select("component", "i", "j", "w", pack)
    return materialize(left.groupBy("pack").cogroup(right.groupBy("pack")).applyInPandas(lay, "id long, x double, y double"), "axes")


def _centres(labels: DataFrame, n_parts: int, matrix: DataFrame | None, seed: int) -> DataFrame:
    """(component, cx, cy, room): a place for each component and half its distance from the nearest other.

    Few components lie on a simplex; more by a spectral layout of their means, a row
    each, however many there are (``component_centres``); without features they are
    scattered by their number.
    """
    spark = labels.sparkSession
    if n_parts > 4 and matrix is None:
        at = labels.select("component").distinct()
        return at.select("component", *[(uniform(seed, F.col("component"), c) * 2 - 1).alias(f"c{c}") for c in "xy"], F.lit(0.5 / n_parts**0.5).alias("room"))
    names = np.sort(rounds.arrays(labels.select("component").distinct())["component"])

    def means() -> np.ndarray:
        rows = rounds.arrays(E.part_means(matrix, labels.select(F.col("i").alias("id"), F.col("component").alias("part"))))
        out = np.zeros((n_parts, int(rows["p"].max()) + 1))
        out[np.searchsorted(names, rows["part"]), rows["p"]] = rows["x"]
        return out

    centre = component_centres(n_parts, means, 2, seed, spark)
    found = rounds.table(spark, names, np.column_stack([centre, np.sqrt(least_gaps(centre)) / 2]))
    return found.select(F.col("id").alias("component"), *[F.get("x", F.lit(c)).alias(n) for c, n in enumerate(("cx", "cy", "room"))])


def spectral_start(graph: DataFrame, nodes: DataFrame, span: float = 10.0, seed: int = 42, tolerance: float = 1e-4, matrix: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(id, x, y): leading eigenvectors of the normalised graph but the first, component by component; written.

    Each component is laid out by itself, centred and scaled into the room around
    its place among the others. A large one costs an eigensolver's run of its own;
    there are no more than nodes / SMALL_PART of these. ``matrix`` (id, features)
    gives the means that components are placed by; ``rounds`` bounds the solver's
    cycles where the tolerance isn't met before.
    """
    labels = E.components(nodes.select(F.col("id").alias("i")), graph)
    sizes = labels.groupBy("component").count()
    n_parts = sizes.count()
    if n_parts <= 1:
        out = owned = _own_axes(graph, nodes, seed, tolerance, rounds)
    else:
        large = [r["component"] for r in sizes.where(F.col("count") > SMALL_PART).orderBy("component").collect()]  # at most nodes / SMALL_PART
        small = labels.join(sizes.where(F.col("count") <= SMALL_PART).select("component"), "component", "left_semi").select("i", "component")
        parts = [_small_axes(graph, small, seed)]
        for k, c in enumerate(large):
            mine = labels.where(F.col("component") == c).select("i")
            inner = graph.join(mine, "i", "left_semi")
            parts.append(_own_axes(inner, mine.select(F.col("i").alias("id")), seed + k, tolerance, rounds))
        axes = parts[0]
        for part in parts[1:]:
            axes = axes.union(part)
        each = axes.join(labels.withColumnRenamed("i", "id"), "id")
        mean = each.groupBy("component").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("top"))
        known = mean.join(_centres(labels, n_parts, matrix, seed), "component")
        scale = F.col("room") / F.when(F.col("top") > 0, 2 * F.col("top")).otherwise(1.0)
        out = owned = materialize(each.join(known, "component").select("id", *[(F.col(f"c{c}") + (F.col(c) - F.col(f"m{c}")) * scale).alias(c) for c in "xy"]), "axes")
        discard(*parts)
    s = out.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max(F.abs("x")).alias("tx"), F.max(F.abs("y")).alias("ty")).first()
    top = max(abs(s["tx"]) + abs(s["mx"]), abs(s["ty"]) + abs(s["my"])) or 1.0
    started = materialize(out.select("id", *[((F.col(c) - s[f"m{c}"]) * (span / top) + 1e-4 * normal(seed, F.col("id"), c)).alias(c) for c in "xy"]), "spectral-start")
    discard(labels, owned)
    return started


def _start(matrix: DataFrame, graph: DataFrame | None, places: DataFrame, kind: str, span: float | None, seed: int) -> DataFrame:
    """(id, x, y) by place."""
    if kind == "spectral":
        placed = matrix.join(places, "id").select(F.col("place").alias("id"), "features")
        return spectral_start(graph, places.select(F.col("place").alias("id")), 10.0 if span is None else span, seed, matrix=placed)
    if kind == "random":
        half = 10.0 if span is None else span
        found = matrix.select("id", *[((uniform(seed, F.col("id"), c) * 2 - 1) * half).alias(c) for c in "xy"])
    elif kind == "pca":
        found = first_two_axes(matrix, 1.0 if span is None else span)
    else:
        raise UnknownOption(f"no start {kind!r}; there are spectral, pca and random")
    return found.join(places, "id").select(F.col("place").alias("id"), "x", "y")


def umap(matrix: DataFrame, p: UmapParams = UmapParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """UMAP, or densMAP where ``density`` is above 0, by hashed negatives of a fixed number at the smaller end; the optimiser is ``adam_parallel``."""
    if p.optimiser != "adam_parallel" or p.n_dim != 2:
        raise UnknownOption("a distributed UMAP has two dimensions and the optimiser adam_parallel")
    n, _ = shape(matrix)
    near = neighbours(matrix, p.k, given, p.knn)
    places = _places(matrix)
    union = materialize(affinity.umap_graph(near, p.k, p.local_connectivity, p.mix, None), "umap-union")
    graph = materialize(_placed(E.prune(union, p.prune_epochs or p.n_epochs), places, "w"), "umap-graph")
    schedule = materialize(epochs.umap_schedule(graph), "schedule")
    started = _start(matrix, graph, places, p.init, p.init_range, seed)
    state = materialize(_state(started), "layout")
    discard(union, started)
    original = None
    if p.density > 0:
        nodes = places.select(F.col("place").alias("i"))
        original = materialize(density.original_radii(nodes, graph, _placed(near, places, "rank", "d")), "radii")
    discard(near)
    a, b = fit_ab(p.min_dist, p.spread)
    if n <= ROUNDS_UP_TO:
        blocks = rounds.schedule_blocks(schedule, n)
        x = rounds.umap(blocks, _xy(state), UmapOptions(a, b, p.lr, p.gamma, p.n_epochs, p.negatives), seed, "one", _held(original, p))
        blocks.close()
        discard(state)
        state = _layout(matrix.sparkSession, x)
    for epoch in range(p.n_epochs if n > ROUNDS_UP_TO else 0):
        at = state.select("id", "x", "y")
        g = epochs.umap_gradient(schedule, at, n, epoch, a, b, p.gamma, p.negatives, seed)
        if original is not None and (epoch + 1) / p.n_epochs > 1 - p.density_share:
            g = _with_density(g, graph, epochs.due(schedule, epoch), at, original, p, a, b)
        root = (1 - 0.9 ** (epoch + 1)) ** 0.5
        rate = p.lr * (1 - epoch / p.n_epochs) * root / (1 - 0.5 ** (epoch + 1))
        before, state = state, materialize(_adam(state, g, rate, root * 1e-7, 0.5, 0.9, F.col("n_active") > 0), "layout")
        discard(before, g)
    discard(graph, schedule, *([] if original is None else [original]))
    return _result(state, places)


def _with_density(g: DataFrame, graph: DataFrame, now: DataFrame, positions: DataFrame, original: DataFrame, p: UmapParams, a: float, b: float) -> DataFrame:
    """The gradient with densMAP's term; radii in the embedding are those of these positions."""
    radii = materialize(epochs.umap_radii(graph, positions, a, b).join(original.select(F.col("i").alias("id"), "r"), "id"), "embedding-radii")
    stats = density.correlation_stats(radii, shift=p.density_shift)
    more = epochs.umap_density_gradient(now, positions, epochs.density_weights(radii, stats), epochs.density_scale(original, stats, p.density), a, b)
    both = g.join(more.toDF("id", "dx", "dy"), "id", "left")
    return owning(both.select("id", *[(F.col(f"g{c}") + F.coalesce(f"d{c}", F.lit(0.0))).alias(f"g{c}") for c in "xy"], "n_active"), radii)


def pacmap(matrix: DataFrame, p: PacmapParams = PacmapParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """PaCMAP: the batch is all pairs, so this is the same method at any size."""
    n, _ = shape(matrix)
    near = neighbours(matrix, min(p.window[1], n - 1), given, p.knn)
    places = _places(matrix)
    pairs = materialize(epochs.pacmap_pairs(_placed(near, places, "rank", "d"), n, p.near, p.mid, p.further, *p.window, seed), "pairs")
    near_graph = materialize(E.mean_of_both(pairs.where("kind = 'near'").select("i", "j", F.lit(1.0).alias("w"))), "pairs-graph") if p.init == "spectral" else None
    discard(near)
    state = materialize(_state(_start(matrix, near_graph, places, p.init, p.init_range, seed)), "layout")
    if n <= ROUNDS_UP_TO:
        blocks = rounds.pair_blocks(pairs, n)
        x = rounds.pacmap(blocks, _xy(state), p.n_epochs, p.lr, *p.phases)
        blocks.close()
        discard(state)
        state = _layout(matrix.sparkSession, x)
    for epoch in range(p.n_epochs if n > ROUNDS_UP_TO else 0):
        g = epochs.pacmap_gradient(pairs, state.select("id", "x", "y"), epoch, *p.phases)
        root = (1 - 0.999 ** (epoch + 1)) ** 0.5
        before, state = state, materialize(_adam(state, g, p.lr * root / (1 - 0.9 ** (epoch + 1)), root * 1e-7, 0.9, 0.999, F.lit(True)), "layout")
        discard(before)
    discard(pairs)
    return _result(state, places)


#: Repulsions over tables, by the method's name.
REPULSIONS = {
    "exact": lambda p: epochs.tsne_repulsion_exact,
    "fft": lambda p: partial(epochs.tsne_repulsion_grid, nodes=p.interpolation_points),
    "bh": lambda p: partial(barnes_hut.repulsion, theta=p.theta),
    "barnes_hut": lambda p: partial(barnes_hut.repulsion, theta=p.theta),
}


def tsne(matrix: DataFrame, p: TsneParams = TsneParams(method="fft"), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """t-SNE by Barnes-Hut, by interpolation on a grid, or by all pairs with method ``exact``; den-SNE where ``density`` is above 0.

    Beyond ROUNDS_UP_TO points an epoch costs a join of the edges with the positions and
    some passes over these; the density term, in the last ``density_share`` of the epochs, two more.
    """
    if p.n_dim != 2:
        raise WrongDimensions("t-SNE layouts have two dimensions")
    if p.method not in REPULSIONS:
        raise UnknownOption(f"a distributed t-SNE has the methods {sorted(REPULSIONS)}")
    n, _ = shape(matrix)
    joint, near = tsne_graph(matrix, p, given)
    places = _places(matrix)
    graph = materialize(_placed(joint, places, "w"), "tsne-placed")
    original = None
    if p.density > 0:
        original = materialize(density.original_radii(places.select(F.col("place").alias("i")), graph, _placed(near, places, "rank", "d")), "radii")
    discard(joint, near)
    state = _start(matrix, graph, places, p.init, p.init_range, seed)
    state = materialize(state.select("id", "x", "y", *[F.lit(0.0).alias(c) for c in ("ux", "uy")], *[F.lit(1.0).alias(c) for c in ("wx", "wy")]), "layout")
    o = TsneOptions(p.n_epochs, p.lr, p.early_exaggeration, p.early_epochs, p.late_exaggeration, p.theta, p.interpolation_points)
    if n <= ROUNDS_UP_TO:
        blocks = edge_blocks(graph, n)
        x = rounds.tsne(blocks, _xy(state), o, p.method, _held(original, p))
        blocks.close()
        discard(state)
        state = _layout(matrix.sparkSession, x)
    repel = REPULSIONS[p.method](p)
    for epoch in range(p.n_epochs if n > ROUNDS_UP_TO else 0):
        forces = []

        def once(positions: DataFrame) -> DataFrame:
            found = repel(positions)  # Barnes-Hut's is written already
            forces.append(found if p.method in ("bh", "barnes_hut") else materialize(found, "repulsion"))
            return forces[-1]

        at = state.select("id", "x", "y")
        g = epochs.tsne_gradient(graph, at, p.early_exaggeration if epoch < p.early_epochs else p.late_exaggeration, once)
        if original is not None and (epoch + 1) / p.n_epochs > 1 - p.density_share:
            radii = materialize(epochs.tsne_radii(graph, at).join(original.select(F.col("i").alias("id"), "r"), "id"), "embedding-radii")
            less = epochs.densne_gradient(graph, at, radii, density.correlation_stats(radii, shift=p.density_shift), p.density)
            forces.append(radii)
            g = g.join(less.toDF("id", "dx", "dy"), "id", "left").select("id", *[(F.col(f"g{c}") - F.coalesce(f"d{c}", F.lit(0.0))).alias(f"g{c}") for c in "xy"])
        g = materialize(g, "gradient")
        moved = materialize(epochs.tsne_step(state, g, o.rate(n), o.momentum[0] if epoch < o.momentum[2] else o.momentum[1]), "layout")
        discard(state, g, *forces)
        state = moved
    discard(graph, *([] if original is None else [original]))
    return _result(state, places)


def diffusion_time(op: DataFrame, nodes: DataFrame, t: int | None, t_max: int, seed: int = 42, known: int = 6) -> int:
    """The given time, or the knee of the entropies of the first t_max powers of an operator that needn't be symmetric.

    Its singular values are the eigenvalues of the symmetric matrix with the operator
    and its transpose beside the diagonal, each of either sign, so every entropy there is larger
    by ln 2, which moves no knee. Nodes are numbers of 62 bits at most.
    """
    if t is not None:
        if t < 1:
            raise ValueError("the diffusion time must be at least 1")
        return t
    left = op.select((F.col("i") * 2).alias("i"), (F.col("j") * 2 + 1).alias("j"), "w")
    both = materialize(left.union(left.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "both-sides")
    twice = nodes.select((F.col("id") * 2).alias("id")).union(nodes.select((F.col("id") * 2 + 1).alias("id")))
    found = eigen.extreme_eigenpairs(both, twice, known, seed=seed)
    # A pair (value, left and right) comes with (-value, left and less right).
    flipped = F.when(F.col("id") % 2 == 0, F.col("v")).otherwise(F.transform("v", lambda x: -x))
    signs = eigen.Eigenpairs(np.concatenate([found.values, -found.values]), found.vectors.select("id", F.concat("v", flipped).alias("v")), np.concatenate([found.residuals] * 2), found.cycles)
    curve = eigen.spectral_entropies(both, twice, t_max, signs)
    discard(both, found.vectors)
    return max(knee(curve), 1)


def phate(matrix: DataFrame, p: PhateParams = PhateParams(), given: DataFrame | None = None, seed: int = 42, most_columns: int | None = None, n_pivots: int = 256, rounds: int = 20) -> DataFrame:
    """PHATE without landmarks for any number of points.

    Distances of potentials are those over all columns of the power, numbers of nodes squared, or, where
    ``most_columns`` is given, an estimate from so many, scaled by their share. ``classic`` scaling places by
    ``n_pivots`` pivots; ``sgd_dense`` starts there and takes ``rounds`` of stress descent (``operators.scaling``).
    """
    if p.mds not in ("classic", "sgd_dense", "dense"):
        raise UnknownOption(f"no scaling {p.mds!r}; there are classic and sgd_dense")
    n, _ = shape(matrix)
    op = phate_operator(matrix, replace(p, n_landmarks=None), given, seed).full
    nodes = matrix.select("id")
    t = diffusion_time(op, nodes, p.t, p.t_max, seed)
    columns = scaling.chosen(nodes, most_columns, seed)
    powered = scaling.power_columns(op, nodes, columns, t)
    rows = materialize(powered.select("id", scaling.transformed(F.col("v"), p.gamma).alias("v")), "potential")
    discard(op, powered)
    out = scaling.scaled(rows, columns, n, p.n_dim, n_pivots, 0 if p.mds == "classic" else rounds, "cosine" if p.knn.metric == "cosine" else "euclidean", seed)
    discard(rows)
    return out


def diffusion_maps(matrix: DataFrame, p: DiffusionParams = DiffusionParams(), given: DataFrame | None = None, seed: int = 42, tolerance: float = 1e-4) -> DataFrame:
    """Diffusion maps of any number of points: eigenvectors by ``eigen.extreme_eigenpairs``, the diffusion time by ``eigen.spectral_entropies`` where none is given.

    Landmarks have no part in it; with them ``pipelines.diffusion_maps`` has no bound either.
    """
    nodes = matrix.select("id")
    lazy, roots = diffusion_maps_operator(matrix, p, given)
    op = materialize(lazy, "diffusion-operator")
    # Some pairs more than asked for make the entropies of high powers exact.
    found = eigen.extreme_eigenpairs(op, nodes, p.n_dim + 1 if p.t is not None else p.n_dim + 6, tolerance=tolerance, seed=seed)
    t = p.t if p.t is not None else max(knee(eigen.spectral_entropies(op, nodes, p.t_max, found)), 1)
    scale = [float(abs(v) ** t * np.sign(v) ** t) for v in found.values[1 : p.n_dim + 1]]
    x = F.array(*[F.get("v", F.lit(c + 1)) * f / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0) for c, f in enumerate(scale)])
    out = materialize(found.vectors.join(roots.withColumnRenamed("i", "id"), "id", "left").select("id", x.alias("x")), "diffusion-maps")
    discard(op, lazy, found.vectors)
    return out
