"""Parameters of the methods, with the usual two-dimensional defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class SearchParams:
    """Options of all searches; each takes its own and leaves the others alone. None: the search's default."""

    n_tree: int = 50
    search_budget: int | None = None  # annoy: candidates of a row over all trees
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    diversify_prob: float = 0.0
    delta: float = 0.001
    ef_budget: int | None = None  # nndescent: neighbours of a node that take part in a round
    bt_budget: float = 1.0  # balltree: share of the rows looked at; below 1 it isn't exact
    n_list: int | None = None
    n_probes: int | None = None

    def of(self, search: str) -> dict:
        """Keyword arguments of one search."""
        return {
            "annoy": {"n_trees": self.n_tree, **({"leaf_rows": max(1, self.search_budget // self.n_tree)} if self.search_budget else {})},
            "hnsw": {"m": self.m, "ef_construction": self.ef_construction, "ef_search": self.ef_search},
            "nndescent": {"delta": self.delta, "diversify_prob": self.diversify_prob, "candidates": self.ef_budget},
            "balltree": {"bt_budget": self.bt_budget, "n_list": self.n_list}, "kmknn": {"n_list": self.n_list}, "ivf": {"n_list": self.n_list, "n_probes": self.n_probes},
        }.get(search, {})


@dataclass
class KnnParams:
    """A search and its options: by name, or all of them together."""

    search: str = "kmknn"
    metric: str = "euclidean"
    options: dict = field(default_factory=dict)
    params: SearchParams | None = None


@dataclass
class UmapParams:
    n_dim: int = 2
    k: int = 15
    knn: KnnParams = field(default_factory=KnnParams)
    optimiser: str = "adam_parallel"
    init: str = "spectral"
    init_range: float | None = None
    randomised: bool = False
    min_dist: float = 0.5
    spread: float = 1.0
    local_connectivity: float = 1.0
    mix: float = 1.0
    n_epochs: int = 500
    prune_epochs: int | None = None  # edges too weak to be sampled in so many epochs are left out; None: n_epochs
    negatives: int = 5
    lr: float = 1.0
    gamma: float = 1.0
    density: float = 0.0
    density_share: float = 0.3
    density_shift: float = 0.1


def densmap_params(density: float = 2.0, **kw) -> UmapParams:
    return UmapParams(density=density, **kw)


@dataclass
class TsneParams:
    n_dim: int = 2
    perplexity: float = 30.0
    knn: KnnParams = field(default_factory=KnnParams)
    method: str = "barnes_hut"
    init: str = "pca"
    init_range: float | None = None
    randomised: bool = True
    n_epochs: int = 1000
    lr: float | None = None
    early_exaggeration: float = 12.0
    early_epochs: int = 250
    late_exaggeration: float = 1.0
    theta: float = 0.5
    interpolation_points: int = 3
    density: float = 0.0
    density_share: float = 0.3
    density_shift: float = 0.1


def densne_params(density: float = 0.1, **kw) -> TsneParams:
    return TsneParams(density=density, **kw)


@dataclass
class PhateParams:
    n_dim: int = 2
    k: int = 5
    knn: KnnParams = field(default_factory=KnnParams)
    decay: float | None = 40.0
    scale: float = 1.0
    least: float = 1e-4
    symmetry: str = "average"
    n_landmarks: int | None = None
    landmarks: str = "spectral"
    n_svd: int = 100
    t: int | None = None
    t_max: int = 100
    gamma: float = 1.0
    mds: str = "sgd_dense"
    mds_iter: int = 800
    mds_lr: float = 0.001
    randomised: bool = True


@dataclass
class DiffusionParams:
    n_dim: int = 2
    k: int = 5
    knn: KnnParams = field(default_factory=KnnParams)
    decay: float = 2.0
    scale: float = 1.0
    least: float = 1e-4
    symmetry: str = "add"
    alpha: float = 1.0
    t: int | None = None
    t_max: int = 100
    n_landmarks: int | None = None
    landmarks: str = "spectral"


@dataclass
class PacmapParams:
    n_dim: int = 2
    near: int = 10
    mid: int = 5
    further: int = 20
    window: tuple[int, int] = (4, 50)
    knn: KnnParams = field(default_factory=KnnParams)
    optimiser: str = "adam_parallel"
    init: str = "pca"
    init_range: float | None = 0.01
    n_epochs: int = 450
    lr: float = 0.01
    phases: tuple[int, int] = (100, 200)


@dataclass
class ParametricParams:
    n_dim: int = 2
    k: int = 15
    knn: KnnParams = field(default_factory=lambda: KnnParams("hnsw"))
    hidden: tuple[int, ...] = (128, 128, 128)
    min_dist: float = 0.5
    spread: float = 1.0
    lr: float = 0.001
    n_epochs: int = 500
    prune_epochs: int | None = None
    batch: int = 256
    negatives: int = 5
    correlation: float = 0.0
