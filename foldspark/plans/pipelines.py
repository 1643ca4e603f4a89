"""The methods end to end: DataFrame (id, features) to DataFrame (id, x array<double>).

Neighbours, affinities, operators and pairs are DataFrame plans of any size.
Their result, a sparse graph, stays in blocks with the executors (``operators.rounds``):
an epoch is a round over them, and the driver holds the layout, some numbers a
point, which MOST_POINTS bounds; ``distributed`` has the layouts without that
bound. Nodes are numbered 0 .. n - 1 by sorted id for the layout only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DegenerateRadii, NoData, NoGraphEdges, TooLargeForOneTask, UnknownOption, WrongDimensions
from ..functions import layout_tsne, layout_umap, linalg
from ..functions.curves import fit_ab
from ..functions.mlp import Mlp, TrainOptions, train
from ..materialize import discard, materialize, owning
from ..operators import affinity, density, diffusion, edges as E, epochs, rounds, svd
from ..operators.knn import distances, knn, parse_search
from ..operators.svd import principal_scores
from ..sources.matrix import shape
from .params import DiffusionParams, KnnParams, ParametricParams, PacmapParams, PhateParams, TsneParams, UmapParams

#: Points of a layout that the driver holds, some ten numbers each: 160 MB. One in one task has a graph of about 1 GB then.
MOST_POINTS = 2_000_000
#: Points whose distances are held as one dense matrix: 800 MB.
MOST_DENSE = 10_000
#: Components whose means are laid out by one dense matrix; those of more by products with it, and components of up to so many nodes by one matrix each.
MOST_PARTS = 2000


def bounded(n: int, most: int, what: str) -> None:
    if n > most:
        raise TooLargeForOneTask(f"{what} takes at most {most} points, not {n}")


class Numbered:
    """Ids in order, and arrays of places from tables of ids."""

    def __init__(self, matrix: DataFrame, most: int = MOST_POINTS):
        n, self.dims = shape(matrix)
        bounded(n, most, "a layout")
        self.ids = np.sort(rounds.arrays(matrix.select("id"))["id"])
        self.n, self._matrix, self._places = n, matrix, None

    @property
    def places(self) -> DataFrame:
        """(id, place), written; ``close`` deletes it."""
        if self._places is None:
            self._places = rounds.places(self._matrix)
        return self._places

    def close(self) -> None:
        if self._places is not None:
            discard(self._places)
            self._places = None

    def at(self, ids) -> np.ndarray:
        return np.searchsorted(self.ids, np.asarray(ids, np.int64))

    def edges(self, graph: DataFrame, w: str = "w") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rounds.arrays(graph.select("i", "j", w))
        i, j, v = self.at(rows["i"]), self.at(rows["j"]), rows[w].astype(float)
        order = np.lexsort((j, i))
        return i[order], j[order], v[order]

    def columns(self, df: DataFrame, *names: str) -> list[np.ndarray]:
        """Columns of a table with a row for each id, by place."""
        rows = rounds.arrays(df.select("id", *names))
        order = np.argsort(rows["id"])
        return [rows[c][order] for c in names]

    def means(self, matrix: DataFrame, part: np.ndarray) -> np.ndarray:
        """Means of the features of each part (one number for each node): a table of parts by dimensions comes to the driver, not the features."""
        parts = rounds.table(matrix.sparkSession, self.ids, part, "part").select("id", F.col("part").cast("long").alias("part"))
        sums = rounds.arrays(E.part_means(matrix, parts))
        out = np.zeros((int(part.max()) + 1, self.dims))
        out[sums["part"], sums["p"]] = sums["x"]
        return out

    def frame(self, spark, x: np.ndarray) -> DataFrame:
        return rounds.table(spark, self.ids, x)


def neighbours(matrix: DataFrame, k: int, given: DataFrame | None, params: KnnParams) -> DataFrame:
    """The given table if it is wide enough, else a search; written, for it is read by several steps."""
    if given is not None:
        narrow = given.groupBy("i").count().agg(F.min("count")).first()[0]
        if narrow is None or narrow < min(k, shape(matrix)[0] - 1):
            raise WrongDimensions(f"the neighbour table has rows of {narrow} entries; {k} are needed")
        return given.where(F.col("rank") <= k)
    options = {**(params.params.of(parse_search(params.search)) if params.params else {}), **params.options}
    found = knn(matrix, k, params.search, params.metric, **options)
    out = materialize(found, "knn")
    discard(found)
    return out


# Starts of layouts

def _spectral_part(i, j, w, n: int, n_dim: int, seed: int) -> np.ndarray:
    if n <= n_dim + 1:
        return np.random.default_rng(seed).uniform(-1, 1, (n, n_dim))
    d = np.bincount(i, w, n)
    s = np.where(d > 1e-8, 1 / np.sqrt(np.maximum(d, 1e-300)), 0.0)
    m = linalg.Sparse(i, j, w * s[i] * s[j], n)
    _, v = linalg.symmetric_eigen(m, n_dim + 1, True, seed)
    out = v[:, 1 : n_dim + 1]
    return out if out.shape[1] == n_dim else np.hstack([out, np.zeros((n, n_dim - out.shape[1]))])


def component_centres(n_parts: int, means, n_dim: int, seed: int, spark: SparkSession | None = None) -> np.ndarray:
    """A place for each component: the corners of a simplex and its mirror for few, a spectral layout of their means for more.

    That of more than MOST_PARTS is the same by products with the matrix of their
    affinities, which tasks make by blocks of rows: work of components squared.
    """
    if n_parts <= 2 * n_dim:
        return np.vstack([np.eye(n_dim), -np.eye(n_dim)])[:n_parts]
    m = means()
    if n_parts > MOST_PARTS:
        near = rounds.Affinity(spark, m)
        _, v = linalg.lanczos(near.times, n_parts, n_dim + 1, True, seed)
        near.close()
        centre = np.hstack([v[:, 1:], np.zeros((n_parts, n_dim + 1 - v.shape[1]))])
    else:
        d2 = distances(m, m, "euclidean")
        near = np.exp(-d2 / max(d2.max(), 1e-300))
        a, b = np.nonzero(~np.eye(n_parts, dtype=bool))
        centre = _spectral_part(a, b, near[a, b], n_parts, n_dim, seed)
    return centre / (np.abs(centre).max() or 1.0)


def least_gaps(centre: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """The squared distance of each place from the nearest other, some rows at once."""
    out = np.empty(len(centre))
    for s in range(0, len(centre), at_once):
        gap = distances(centre[s : s + at_once], centre, "euclidean")
        gap[np.arange(len(gap)), np.arange(s, s + len(gap))] = np.inf
        out[s : s + at_once] = gap.min(1)
    return out


def _axes(part: int, nodes: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, n_dim: int, seed: int) -> np.ndarray:
    return _spectral_part(i, j, w, len(nodes), n_dim, seed + part)


def spectral_start(blocks: rounds.Blocks, means, n_dim: int, seed: int, spark: SparkSession, span: float = 10.0) -> np.ndarray:
    """Leading eigenvectors of the normalised graph, component by component, centred and scaled to ``span``, with slight noise.

    Components of up to MOST_PARTS nodes are laid out in tasks, larger ones by a round for each
    product; edges don't come to the driver. ``means`` is a function of each node's component
    that gives the components' mean features.
    """
    n = blocks.n
    parts, number, sizes = np.unique(rounds.labels(blocks), return_inverse=True, return_counts=True)
    small = rounds.small_parts(blocks, np.where(sizes[number] <= MOST_PARTS, number, -1), partial(_axes, n_dim=n_dim, seed=seed))
    degree = rounds.degrees(blocks)
    # Nodes sorted by component, so that each is cut out once.
    rows = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[rows], np.arange(len(parts) + 1))
    centre = component_centres(len(parts), lambda: means(number), n_dim, seed, spark) if len(parts) > 1 else np.zeros((1, n_dim))
    room = np.sqrt(least_gaps(centre)) / 2 if len(parts) > 1 else None
    out = np.zeros((n, n_dim))
    for p in range(len(parts)):
        at = rows[starts[p] : starts[p + 1]]
        if p in small:
            own = small[p][1]
        elif len(at) > MOST_PARTS:
            own = rounds.leading(blocks, degree, at, n_dim + 1, seed + p)[:, 1 : n_dim + 1]
            own = np.hstack([own, np.zeros((len(at), n_dim - own.shape[1]))])
        else:
            own = np.zeros((len(at), n_dim))  # a node without edges
        own = own - own.mean(0)
        out[at] = own if room is None else centre[p] + own / (np.abs(own).max() or 1.0) * room[p]
    out = out - out.mean(0)
    out = out / (np.abs(out).max() or 1.0) * span
    return out + np.random.default_rng(seed).normal(0, 1e-4, out.shape)


def start(kind: str, span: float | None, blocks: rounds.Blocks | None, at: Numbered, matrix: DataFrame, n_dim: int, seed: int, randomised: bool = False) -> np.ndarray:
    """A spectral start, of the graph in blocks, brings the means of components to the driver, a principal-axes one the scores; none the features."""
    n = at.n
    if kind == "spectral":
        return spectral_start(blocks, lambda part: at.means(matrix, part), n_dim, seed, matrix.sparkSession, 10.0 if span is None else span)
    if kind == "random":
        half = 10.0 if span is None else span
        return np.random.default_rng(seed).uniform(-half, half, (n, n_dim))
    if kind == "pca":
        found = principal_scores(matrix, n_dim, randomised, seed)
        scores = np.stack(at.columns(found.select("id", *[F.get("v", F.lit(c)).alias(f"v{c}") for c in range(n_dim)]), *[f"v{c}" for c in range(n_dim)]), axis=1)
        discard(found)
        sd = scores.std(0)
        return (scores - scores.mean(0)) / np.where(sd > 0, sd, 1) * (1.0 if span is None else span)
    raise UnknownOption(f"no start {kind!r}; there are spectral, pca and random")


def _density(matrix: DataFrame, graph: DataFrame, near: DataFrame, at: Numbered, p) -> layout_umap.Density | None:
    if p.density <= 0:
        return None
    r, mu = at.columns(density.original_radii(matrix.select(F.col("id").alias("i")), graph, near).withColumnRenamed("i", "id"), "r", "mu_sum")
    return layout_umap.Density(r, mu.sum() / 2, p.density, p.density_share, p.density_shift)


def graph_blocks(graph: DataFrame, at: Numbered) -> rounds.Blocks:
    """An undirected graph (i, j, w) of ids, as its edges are sampled by UMAP's schedule."""
    schedule = materialize(epochs.umap_schedule(rounds.placed(graph, at.places, "w")), "schedule")
    out = rounds.schedule_blocks(schedule, at.n)
    discard(schedule)
    return out


# Methods

def umap_graph(matrix: DataFrame, p: UmapParams = UmapParams(), given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fuzzy graph, neighbours)."""
    near = neighbours(matrix, p.k, given, p.knn)
    return materialize(affinity.umap_graph(near, p.k, p.local_connectivity, p.mix, p.prune_epochs or p.n_epochs), "umap-graph"), near


def umap(matrix: DataFrame, p: UmapParams = UmapParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """UMAP, or densMAP where ``density`` is above 0."""
    if p.optimiser not in ("sgd", "adam", "adam_parallel", "adam_gpu"):
        raise UnknownOption(f"no optimiser {p.optimiser!r}")
    graph, near = umap_graph(matrix, p, given)
    at = Numbered(matrix)
    blocks = graph_blocks(graph, at)
    if not blocks.total:
        raise NoGraphEdges("no edge joins two nodes")
    held = _density(matrix, graph, near, at, p)
    x = start(p.init, p.init_range, blocks, at, matrix, p.n_dim, seed, p.randomised)
    a, b = fit_ab(p.min_dist, p.spread)
    o = layout_umap.UmapOptions(a, b, p.lr, p.gamma, p.n_epochs, p.negatives)
    if p.optimiser in ("sgd", "adam"):
        out = layout_umap.sequential(x, *at.edges(graph), o, seed, held, p.optimiser == "adam")
    else:
        out = rounds.umap(blocks, x, o, seed, "both" if p.optimiser == "adam_gpu" else "scheduled", held)
    blocks.close()
    at.close()
    discard(graph, near)
    return at.frame(matrix.sparkSession, out)


def tsne_graph(matrix: DataFrame, p: TsneParams = TsneParams(), given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(joint probabilities, neighbours)."""
    n, _ = shape(matrix)
    k = max(min(int(3 * p.perplexity), n - 1), min(5, n - 1))
    near = neighbours(matrix, k, given, p.knn)
    return materialize(affinity.tsne_graph(near, p.perplexity, n), "tsne-graph"), near


def tsne(matrix: DataFrame, p: TsneParams = TsneParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """t-SNE, or den-SNE where ``density`` is above 0."""
    if p.n_dim != 2:
        raise WrongDimensions("t-SNE layouts have two dimensions")
    o = layout_tsne.TsneOptions(p.n_epochs, p.lr, p.early_exaggeration, p.early_epochs, p.late_exaggeration, p.theta, p.interpolation_points)
    layout_tsne.repulsion_of(p.method, o)
    graph, near = tsne_graph(matrix, p, given)
    at = Numbered(matrix)
    held = _density(matrix, graph, near, at, p)
    discard(near)
    blocks = edge_blocks(rounds.placed(graph, at.places, "w"), at.n)
    y = start(p.init, p.init_range, blocks, at, matrix, 2, seed, p.randomised)
    out = rounds.tsne(blocks, y, o, p.method, held)
    blocks.close()
    at.close()
    discard(graph)
    return at.frame(matrix.sparkSession, out)


def edge_blocks(edges: DataFrame, n: int) -> rounds.Blocks:
    """Edges (i, j, w) of places, in both directions."""
    written = materialize(edges.select(F.col("i").alias("own"), F.col("j").alias("other"), "w"), "edges")
    out = rounds.Blocks(written, n)
    discard(written)
    return out


def pacmap(matrix: DataFrame, p: PacmapParams = PacmapParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """PaCMAP. Both optimisers sum all pairs before a step, so they are one here."""
    if p.optimiser.lower() not in ("adam", "adam_parallel"):
        raise UnknownOption(f"no optimiser {p.optimiser!r}; there are adam and adam_parallel")
    n, _ = shape(matrix)
    near = neighbours(matrix, min(p.window[1], n - 1), given, p.knn)
    at = Numbered(matrix)
    # Further pairs are draws of places, so ids become places first.
    pairs = materialize(epochs.pacmap_pairs(rounds.placed(near, at.places, "rank", "d"), at.n, p.near, p.mid, p.further, *p.window, seed), "pairs")
    discard(near)
    graph = edge_blocks(E.mirrored(pairs.where("kind = 'near'"), F.lit(1.0).alias("w")), at.n) if p.init == "spectral" else None
    x = start(p.init, p.init_range, graph, at, matrix, p.n_dim, seed)
    blocks = rounds.pair_blocks(pairs, at.n)
    out = rounds.pacmap(blocks, x, p.n_epochs, p.lr, *p.phases)
    blocks.close()
    if graph is not None:
        graph.close()
    at.close()
    discard(pairs)
    return at.frame(matrix.sparkSession, out)


@dataclass
class DiffusionOperator:
    """A Markov operator over all nodes, or over landmarks with the transitions to and from them."""

    full: DataFrame | None = None
    landmark: DataFrame | None = None
    from_landmarks: DataFrame | None = None
    to_landmarks: DataFrame | None = None
    assigned: DataFrame | None = None

    @property
    def small(self) -> DataFrame:
        return self.full if self.full is not None else self.landmark


def phate_operator(matrix: DataFrame, p: PhateParams = PhateParams(), given: DataFrame | None = None, seed: int = 42) -> DiffusionOperator:
    n, _ = shape(matrix)
    near = neighbours(matrix, p.k, given, p.knn)
    kernel = affinity.alpha_decay(near, p.k, p.decay, p.scale, p.least, p.symmetry)
    full = materialize(diffusion.markov(kernel), "phate-operator")
    if p.n_landmarks is None or p.n_landmarks >= n:
        discard(near)
        return DiffusionOperator(full=full)
    if p.landmarks == "spectral":
        _, assigned = diffusion.spectral_landmarks(matrix, full, p.n_landmarks, p.n_svd, seed)
    elif p.landmarks in ("random", "density"):
        marks = diffusion.random_landmarks(matrix, p.n_landmarks, seed) if p.landmarks == "random" else diffusion.density_landmarks(matrix, kernel, p.n_landmarks, seed)
        assigned = diffusion.assign_to_landmarks(matrix, marks, p.knn.metric)
    else:
        raise UnknownOption(f"no landmarks {p.landmarks!r}; there are spectral, random and density")
    lazy, assigned = assigned, materialize(assigned, "phate-assigned")
    discard(lazy)
    p_ln, p_nl, small = (materialize(x, "phate-landmarks") for x in diffusion.landmark_operators(full, assigned))
    discard(near, full)
    return DiffusionOperator(None, small, p_ln, p_nl, assigned)


def _dense(op: DataFrame, most: int, what: str) -> tuple[np.ndarray, np.ndarray]:
    bounded(op.select("i").union(op.select("j")).distinct().count(), most, what)
    rows = op.toPandas()
    ids = np.unique(np.concatenate([rows["i"], rows["j"]])).astype(np.int64)
    return ids, linalg.Sparse(np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"]), rows["w"].to_numpy(float), len(ids)).dense()


def entropies(op: DataFrame, t_max: int, seed: int = 42) -> np.ndarray:
    """Entropies of the powers 1 .. t_max of an operator, from its singular values: all of a small one, the SKETCH_RANK largest beyond.

    Small ones are dense, in one task; the sketch of larger ones stays a table, of any number of nodes.
    """
    if op.select("i").union(op.select("j")).distinct().count() < linalg.DENSE_ENTROPY:
        return linalg.entropy_curve(linalg.singular_values(_dense(op, MOST_DENSE, "an entropy curve")[1], seed), t_max)
    found = svd.sparse_svd(op, linalg.SKETCH_RANK, seed, rounds=0)
    discard(found.left, found.right)
    return linalg.entropy_curve(found.values, t_max)


def diffusion_time(op: np.ndarray, t: int | None, t_max: int, seed: int = 42) -> int:
    """The given time, or the knee of the entropies of the first t_max powers, as an index."""
    if t is not None:
        if t < 1:
            raise ValueError("the diffusion time must be at least 1")
        return t
    return max(linalg.knee(linalg.entropy_curve(linalg.singular_values(op, seed), t_max)), 1)


def phate(matrix: DataFrame, p: PhateParams = PhateParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Diffusion potential and its multidimensional scaling. More than MOST_DENSE points without landmarks stay tables (``distributed``)."""
    n, _ = shape(matrix)
    if n > MOST_DENSE and (p.n_landmarks is None or p.n_landmarks >= n):
        from .distributed import phate as over_tables

        return over_tables(matrix, p, given, seed)
    op = phate_operator(matrix, p, given, seed)
    ids, m = _dense(op.small, MOST_DENSE, "PHATE without landmarks (or with as many)")
    discard(op.small, *(x for x in (op.from_landmarks, op.assigned) if x is not None))
    t = diffusion_time(m, p.t, p.t_max, seed)
    powered = np.linalg.matrix_power(m, t)
    stored = powered > 0
    if p.gamma == 1:
        pot = np.where(stored, -np.log(np.clip(powered, 0, 1) + 1e-7), 0.0)
    elif abs(p.gamma + 1) < 1e-10:
        pot = powered
    else:
        c = (1 - p.gamma) / 2
        pot = np.where(stored, np.where(stored, powered, 1) ** c / c, 0.0)
    if p.knn.metric == "cosine":
        d = distances(pot, pot, "cosine")
    else:
        s = (pot * pot).sum(1)
        d = np.sqrt(np.maximum(s[:, None] + s[None] - 2 * pot @ pot.T, 0))
    np.fill_diagonal(d, 0)
    if p.mds == "classic":
        x = linalg.classic_mds(d, p.n_dim, p.randomised, seed)
    elif p.mds in ("sgd_dense", "dense"):
        x = linalg.sgd_mds(d, p.n_dim, None, seed, p.mds_iter, p.mds_lr)
    else:
        raise UnknownOption(f"no scaling {p.mds!r}; there are classic and sgd_dense")
    spark = matrix.sparkSession
    if op.full is not None:
        return spark.createDataFrame(pd.DataFrame({"id": ids, "x": x.tolist()}), "id long, x array<double>")
    marks = spark.createDataFrame(pd.DataFrame({"landmark": ids, "x": x.tolist()}), "landmark long, x array<double>")
    return diffusion.interpolate(op.to_landmarks, marks).select(F.col("i").alias("id"), "x")


def diffusion_kernel(near: DataFrame, p: DiffusionParams) -> DataFrame:
    return E.anisotropic(affinity.alpha_decay(near, p.k, p.decay, p.scale, p.least, p.symmetry), p.alpha)


def diffusion_maps_operator(matrix: DataFrame, p: DiffusionParams = DiffusionParams(), given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symmetric operator (i, j, w), square roots of degrees (i, s))."""
    near = neighbours(matrix, p.k, given, p.knn)
    kernel = materialize(diffusion_kernel(near, p), "diffusion-kernel")
    discard(near)
    return owning(E.symmetric_operator(kernel), kernel), E.degree(kernel).select("i", F.sqrt("degree").alias("s"))


def _diffusion_coordinates(m: linalg.Sparse, s: np.ndarray, n_dim: int, t: int | None, t_max: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = linalg.symmetric_eigen(m, min(n_dim + 5, m.shape[0] - 1), True, seed)
    time = diffusion_time(m, t, t_max, seed) if t is None else t
    lam = values[1 : n_dim + 1]
    x = np.abs(lam) ** time * np.sign(lam) ** time * vectors[:, 1 : n_dim + 1] / np.where(s > 0, s, 1)[:, None]
    return lam, linalg.fix_signs(x)


def diffusion_maps(matrix: DataFrame, p: DiffusionParams = DiffusionParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Eigenvectors of the diffusion operator after the first, by eigenvalue to the power t, over the square roots of degrees.

    With landmarks their coordinates go to all points by Nystroem's extension. More
    than MOST_DENSE points without landmarks stay tables (``distributed``).
    """
    n, _ = shape(matrix)
    spark = matrix.sparkSession
    if p.n_landmarks is None or p.n_landmarks >= n:
        if n > MOST_DENSE:
            from .distributed import diffusion_maps as over_tables

            return over_tables(matrix, p, given, seed)
        op, roots = diffusion_maps_operator(matrix, p, given)
        at = Numbered(matrix)
        i, j, w = at.edges(op)
        r = roots.toPandas()
        discard(op)
        s = np.zeros(at.n)
        s[at.at(r["i"])] = r["s"]
        return at.frame(spark, _diffusion_coordinates(linalg.Sparse(i, j, w, at.n), s, p.n_dim, p.t, p.t_max, seed)[1])
    if p.landmarks == "random":
        marks = diffusion.random_landmarks(matrix, p.n_landmarks, seed)
    else:
        kernel = materialize(affinity.alpha_decay(neighbours(matrix, p.k, given, p.knn), p.k, p.decay, p.scale, p.least, p.symmetry), "diffusion-kernel")
        if p.landmarks == "density":
            marks = diffusion.density_landmarks(matrix, kernel, p.n_landmarks, seed)
        elif p.landmarks == "spectral":
            marks = diffusion.spectral_landmarks(matrix, E.normalise_rows(kernel), p.n_landmarks, seed=seed)[0]
        else:
            raise UnknownOption(f"no landmarks {p.landmarks!r}; there are spectral, random and density")
    marks = materialize(marks.select("landmark", "features"), "landmarks")
    small = marks.select(F.col("landmark").cast("long").alias("id"), "features")
    near = knn(small, min(p.k, p.n_landmarks - 1), "exhaustive", p.knn.metric)
    kernel = materialize(diffusion_kernel(near, p), "landmark-kernel")
    ids = np.sort(small.select("id").toPandas()["id"].to_numpy(np.int64))
    rows, deg = E.symmetric_operator(kernel).toPandas(), E.degree(kernel).toPandas()
    s = np.zeros(len(ids))
    s[np.searchsorted(ids, deg["i"])] = np.sqrt(deg["degree"])
    m = linalg.Sparse(np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"]), rows["w"].to_numpy(float), len(ids))
    lam, x = _diffusion_coordinates(m, s, p.n_dim, p.t, p.t_max, seed)
    coordinates = spark.createDataFrame(pd.DataFrame({"landmark": ids, "x": x.tolist()}), "landmark long, x array<double>")
    to = diffusion.to_landmark_transitions(matrix, marks, p.k, p.scale, p.least, p.knn.metric)
    return diffusion.nystroem(to, coordinates, [float(v) for v in lam]).select(F.col("i").alias("id"), "x")


def train_encoder(matrix: DataFrame, p: ParametricParams = ParametricParams(), given: DataFrame | None = None, seed: int = 42) -> Mlp:
    """The encoder of parametric UMAP, trained on the edges of the fuzzy graph: batch after batch, in a task that holds features and edges; only the encoder reaches the driver."""
    u = UmapParams(p.n_dim, p.k, p.knn, min_dist=p.min_dist, spread=p.spread, n_epochs=p.n_epochs, prune_epochs=p.prune_epochs)
    graph, near = umap_graph(matrix, u, given)
    n, dims = shape(matrix)
    bounded(n, MOST_POINTS, "training in one task")
    places = rounds.places(matrix)
    edges = materialize(rounds.placed(graph, places), "training-edges")
    discard(graph, near)
    a, b = fit_ab(p.min_dist, p.spread)
    work = partial(_trained, hidden=list(p.hidden), n_dim=p.n_dim, o=TrainOptions(a, b, p.lr, p.n_epochs, p.batch, p.negatives, p.correlation), seed=seed)
    out = Mlp.from_bytes(rounds.in_one_task(matrix.join(places, "id"), edges, n, dims, work))
    discard(places, edges)
    return out


def _trained(x: np.ndarray, i: np.ndarray, j: np.ndarray, hidden: list[int], n_dim: int, o: TrainOptions, seed: int) -> bytes:
    return train(x, i, j, hidden, n_dim, o, seed).to_bytes()


def encode(df: DataFrame, net: Mlp, features: str = "features", to: str = "x") -> DataFrame:
    """Adds the encoder's coordinates; batch or streaming, no state, no action."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("array<double>")
    def forward(v: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.forward(np.stack(v.to_numpy())))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(to, forward(F.col(features).cast("array<double>")))


def parametric_umap(matrix: DataFrame, p: ParametricParams = ParametricParams(), given: DataFrame | None = None, seed: int = 42) -> DataFrame:
    return encode(matrix, train_encoder(matrix, p, given, seed)).select("id", "x")


__all__ = ["DegenerateRadii", "NoData", "umap", "tsne", "pacmap", "phate", "diffusion_maps", "parametric_umap", "train_encoder", "encode"]
