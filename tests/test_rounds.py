"""Layouts by rounds: the one-task layouts to the last bit, and nothing of a graph on the driver."""

import numpy as np
import pytest

from foldspark.functions import layout_tsne, layout_umap
from foldspark.operators import rounds
from foldspark.plans import distributed, pipelines
from foldspark.plans.params import PacmapParams, TsneParams, UmapParams, densne_params


@pytest.fixture(scope="module")
def graph(spark):
    """Undirected edges among 60 nodes, some of them without any."""
    rng = np.random.default_rng(3)
    at = np.unique(np.sort(rng.integers(0, 56, (160, 2)), axis=1), axis=0)
    at = at[at[:, 0] != at[:, 1]]
    w = rng.uniform(0.05, 1, len(at))
    i, j, w = np.concatenate([at, at[:, ::-1]])[:, 0], np.concatenate([at, at[:, ::-1]])[:, 1], np.concatenate([w, w])
    order = np.lexsort((j, i))
    return i[order], j[order], w[order]


def table(spark, graph):
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(*graph)], "i long, j long, w double")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(rounds, "LEAST_NODES", 13)


@pytest.mark.parametrize("method", ["exact", "barnes_hut", "fft"])
def test_tsne_is_that_of_one_task(spark, graph, method):
    y = np.random.default_rng(0).normal(0, 1, (60, 2))
    o, p = layout_tsne.TsneOptions(n_epochs=5, early_epochs=2), graph[2] / graph[2].sum()
    held = layout_umap.Density(np.random.default_rng(1).standard_normal(60), graph[2].sum() / 2, share=0.5)
    blocks = pipelines.edge_blocks(table(spark, (*graph[:2], p)), 60)
    assert blocks.rows.getNumPartitions() > 2
    assert np.array_equal(rounds.tsne(blocks, y, o, method, held), layout_tsne.optimise(y, *graph[:2], p, o, method, held))
    blocks.close()


@pytest.mark.parametrize("method", ["pacmap", "tsne", "densne", "umap_gpu_rule"])
def test_no_graph_comes_to_the_driver(spark, sf_dir, monkeypatch, method):
    from foldspark.sources.matrix import embeddings

    m = embeddings(spark, sf_dir).where("id < 90")
    fetched, real = [], rounds.arrays
    monkeypatch.setattr(rounds, "arrays", lambda df: fetched.append(real(df)) or fetched[-1])
    all_rows = type(m).toPandas
    monkeypatch.setattr(type(m), "toPandas", lambda df: pytest.fail("edges came to the driver") if {"i", "j"} <= set(df.columns) else all_rows(df))
    run = {
        "pacmap": lambda: pipelines.pacmap(m, PacmapParams(n_epochs=2, window=(4, 20))),
        "tsne": lambda: pipelines.tsne(m, TsneParams(n_epochs=2, perplexity=10, randomised=False)),
        "densne": lambda: pipelines.tsne(m, densne_params(n_epochs=2, perplexity=10, randomised=False)),
        "umap_gpu_rule": lambda: pipelines.umap(m, UmapParams(k=5, optimiser="adam_gpu", n_epochs=2, prune_epochs=500)),
    }[method]
    assert run().count() == m.count()
    assert max(len(c) for x in fetched for c in x.values()) <= m.count()


#: Registered layouts, and the plan that each runs with its defaults.
WHOLE = {
    "parametric_umap": (pipelines, "parametric_umap"),
    "umap_sgd": (pipelines, "umap"),
    "pacmap_distributed": (distributed, "pacmap"),
    "umap_distributed": (distributed, "umap"),
    "umap_adam": (pipelines, "umap"),
    "tsne_tree_distributed": (distributed, "tsne"),
    "densne_distributed": (distributed, "tsne"),
    "tsne_distributed": (distributed, "tsne"),
    "tsne_fft": (pipelines, "tsne"),
    "densne": (pipelines, "tsne"),
    "tsne": (pipelines, "tsne"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_registered_layouts_run_all_epochs(monkeypatch, name):
    from foldspark import queries

    (plan, method), given = WHOLE[name], []
    monkeypatch.setattr(plan, method, lambda m, p=None, **o: given.append((p, o)))
    monkeypatch.setattr(queries, "embeddings", lambda s, d: None)
    queries.QUERIES[name](None, "")
    (p, more), = given
    default = type(p)()
    assert not more and all(getattr(p, c) == getattr(default, c) for c in ("n_epochs", "prune_epochs", "phases", "hidden") if hasattr(p, c))


def test_the_encoder_is_trained_off_the_driver(spark, sf_dir, monkeypatch):
    from foldspark.functions import mlp
    from foldspark.functions.curves import fit_ab
    from foldspark.plans.params import KnnParams, ParametricParams, UmapParams
    from foldspark.sources.matrix import embeddings

    m = embeddings(spark, sf_dir).where("id < 90")
    p = ParametricParams(k=5, knn=KnnParams("exhaustive"), hidden=(8,), n_epochs=2, batch=64)
    graph, _ = pipelines.umap_graph(m, UmapParams(k=5, knn=p.knn, n_epochs=2))
    rows = m.toPandas().sort_values("id")
    at = np.searchsorted(rows["id"].to_numpy(), graph.select("i", "j").toPandas().sort_values(["i", "j"]).to_numpy())
    want = mlp.train(np.stack(rows["features"].to_numpy()), at[:, 0], at[:, 1], [8], 2, mlp.TrainOptions(*fit_ab(p.min_dist, p.spread), n_epochs=2, batch=64))
    monkeypatch.setattr(type(m), "toPandas", lambda df: pytest.fail("rows came to the driver"))
    monkeypatch.setattr(pipelines, "train", lambda *a: pytest.fail("trained on the driver"))
    got = pipelines.train_encoder(m, p)
    assert all(np.array_equal(a, b) for a, b in zip(got.weights + got.biases, want.weights + want.biases))


def test_many_components_are_placed_as_few_are(spark, monkeypatch):
    """By products with their affinities or by one matrix: the same places, not scattered ones."""
    means = np.random.default_rng(5).normal(size=(90, 4)) * [6, 3, 1, 1]
    want = pipelines.component_centres(90, lambda: means, 2, 42, spark)
    monkeypatch.setattr(pipelines, "MOST_PARTS", 20)
    np.testing.assert_allclose(pipelines.component_centres(90, lambda: means, 2, 42, spark), want, atol=1e-6)
    from foldspark.sources.matrix import from_vectors

    labels = spark.createDataFrame([(k, k) for k in range(90)], "i long, component long")
    m = from_vectors(spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(means)], "id long, v array<double>"), "id", "v")
    got = distributed._centres(labels, 90, m, 42).toPandas().sort_values("component")
    np.testing.assert_allclose(got[["cx", "cy"]], want, atol=1e-6)


def test_a_spectral_start_by_rounds_parts_components(spark):
    """Three paths, a large one by rounds, small ones in tasks, and a lone node."""
    rows, part, at = [], [], 0
    for c, n in enumerate((40, 12, 9)):
        rows += [(at + k, at + k + 1, 1.0) for k in range(n - 1)]
        part += [c] * n
        at += n
    part = np.array([*part, 3])
    graph = spark.createDataFrame(rows + [(j, i, w) for i, j, w in rows], "i long, j long, w double")
    blocks = pipelines.edge_blocks(graph, len(part))
    assert (rounds.labels(blocks) == np.array([0, 40, 52, 61])[part]).all()
    pipelines_most, pipelines.MOST_PARTS = pipelines.MOST_PARTS, 30
    try:
        got = pipelines.spectral_start(blocks, None, 2, 42, spark)
    finally:
        pipelines.MOST_PARTS = pipelines_most
        blocks.close()
    centres = np.stack([got[part == c].mean(0) for c in range(4)])
    assert min(np.linalg.norm(centres[a] - centres[b]) for a in range(4) for b in range(a)) > 3
    for c in range(3):
        own = got[part == c]
        along = np.cos(np.pi * (np.arange(len(own)) + 0.5) / len(own))
        assert max(abs(np.corrcoef(own[:, k], along)[0, 1]) for k in range(2)) > 0.95


@pytest.mark.parametrize("method", ["umap", "tsne", "pacmap"])
def test_epochs_of_tables_are_rounds(spark, sf_dir, monkeypatch, method):
    """Beyond ROUNDS_UP_TO points an epoch is joins and sums: the same layout but for the order of sums."""
    from foldspark.sources.matrix import embeddings

    m = embeddings(spark, sf_dir).where("id < 70")
    p = {"umap": UmapParams(k=5, n_epochs=4, prune_epochs=500, init="random"), "tsne": TsneParams(n_epochs=2, perplexity=10, method="fft"), "pacmap": PacmapParams(n_epochs=2, window=(4, 20))}[method]

    def layout():
        return np.stack(getattr(distributed, method)(m, p).toPandas().sort_values("id")["x"].to_numpy())

    by_rounds = layout()
    monkeypatch.setattr(distributed, "ROUNDS_UP_TO", 0)
    np.testing.assert_allclose(layout(), by_rounds, atol=1e-6 * np.abs(by_rounds).max())
