"""Numeric kernels against closed forms and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.functions import layout_pacmap, layout_tsne, layout_umap, linalg, mlp
from foldspark.functions.curves import fit_ab
from foldspark.functions.hashing import draw_column, draw_numpy


def test_draws_agree_between_column_and_numpy(spark):
    rows = spark.range(500).select("id", draw_column(42, F.col("id"), F.lit(7), F.col("id") * 3, F.col("id") % 5, 97).alias("k")).toPandas()
    i = rows["id"].to_numpy()
    assert (draw_numpy(42, i, 7, i * 3, i % 5, 97) == rows["k"].to_numpy()).all()


def test_repulsions_agree():
    y = np.random.default_rng(0).standard_normal((300, 2)) * 5
    force, q = layout_tsne.exact_repulsion(y)
    for got in (layout_tsne.tree_repulsion(y, 0.0),):
        np.testing.assert_allclose(got[0], force, atol=1e-9)
        np.testing.assert_allclose(got[1], q, atol=1e-9)
    for got in (layout_tsne.tree_repulsion(y, 0.5), layout_tsne.fft_repulsion(y)):
        assert abs(got[1].sum() / q.sum() - 1) < 0.02
        assert np.linalg.norm(got[0] - force) / np.linalg.norm(force) < 0.05


def test_tree_takes_coincident_points():
    y = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]])
    for a, b in zip(layout_tsne.tree_repulsion(y, 0.0), layout_tsne.exact_repulsion(y)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_eigenpairs():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((60, 60))
    a = a + a.T
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:3]
    np.testing.assert_allclose(linalg.lanczos(lambda x: a @ x, 60, 3)[0], want, rtol=1e-8)
    u, s, v = linalg.randomised_svd(a[:, :8], 8)
    np.testing.assert_allclose((u * s) @ v.T, a[:, :8], atol=1e-8)


def test_classic_scaling_keeps_distances():
    x = np.random.default_rng(2).standard_normal((30, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = linalg.classic_mds(d, 2, randomised=False)
    np.testing.assert_allclose(np.sqrt(((got[:, None] - got[None]) ** 2).sum(2)), d, atol=1e-8)
    close = linalg.sgd_mds(d, 2, seed=1)
    assert np.corrcoef(np.sqrt(((close[:, None] - close[None]) ** 2).sum(2)).ravel(), d.ravel())[0, 1] > 0.99


def test_knee_of_two_lines():
    y = np.concatenate([np.linspace(10, 1, 10), np.linspace(1, 0.5, 20)[1:]])
    assert abs(linalg.knee(y) - 9) <= 1
    with pytest.raises(ValueError):
        linalg.knee(np.array([1.0, 2.0]))


def test_curve_fit_is_near_the_target():
    a, b = fit_ab(0.1, 1.0)
    x = np.linspace(0.01, 3, 100)
    want = np.where(x < 0.1, 1.0, np.exp(-(x - 0.1)))
    assert np.abs(1 / (1 + a * x ** (2 * b)) - want).max() < 0.1


def two_clusters(n=40):
    i, j = np.nonzero((np.arange(n)[:, None] // (n // 2) == np.arange(n)[None] // (n // 2)) & ~np.eye(n, dtype=bool))
    return i, j, np.ones(len(i)), np.arange(n) // (n // 2)


def separation(x, label):
    centre = np.stack([x[label == k].mean(0) for k in (0, 1)])
    return np.linalg.norm(centre[0] - centre[1]) / max(x[label == k].std() for k in (0, 1))


@pytest.mark.parametrize("how", ["parallel", "both_ends", "sgd", "adam"])
def test_umap_layouts_separate(how):
    i, j, w, label = two_clusters()
    x = np.random.default_rng(0).uniform(-1, 1, (40, 2))
    o = layout_umap.UmapOptions(n_epochs=100)
    got = layout_umap.adam_parallel(x, i, j, w, o, both_ends=how == "both_ends") if how in ("parallel", "both_ends") else layout_umap.sequential(x, i, j, w, o, adam=how == "adam")
    assert np.isfinite(got).all() and separation(got, label) > 1


@pytest.mark.parametrize("adam", [False, True])
def test_a_sequential_epoch_draws_once(monkeypatch, adam):
    """Draws of an edge by itself cost more than its moves."""
    made = []
    monkeypatch.setattr(layout_umap, "draw_numpy", lambda *a: made.append(1) or draw_numpy(*a))
    i, j, w, label = two_clusters()
    got = layout_umap.sequential(np.random.default_rng(0).uniform(-1, 1, (40, 2)), i, j, w, layout_umap.UmapOptions(n_epochs=30), adam=adam)
    assert len(made) <= 30 and np.isfinite(got).all()


def test_density_weight_zero_changes_nothing():
    i, j, w, _ = two_clusters()
    x = np.random.default_rng(0).uniform(-1, 1, (40, 2))
    d = layout_umap.Density(np.random.default_rng(1).standard_normal(40), w.sum() / 2, 0.0)
    o = layout_umap.UmapOptions(n_epochs=30)
    np.testing.assert_allclose(layout_umap.adam_parallel(x, i, j, w, o, density=d), layout_umap.adam_parallel(x, i, j, w, o))
    t = layout_tsne.TsneOptions(n_epochs=20)
    np.testing.assert_allclose(layout_tsne.optimise(x, i, j, w / w.sum(), t, "exact", d), layout_tsne.optimise(x, i, j, w / w.sum(), t, "exact"))


@pytest.mark.parametrize("method", ["exact", "barnes_hut", "fft"])
def test_tsne_layouts_separate(method):
    i, j, w, label = two_clusters()
    got = layout_tsne.optimise(np.random.default_rng(0).normal(0, 1e-2, (40, 2)), i, j, w / w.sum(), layout_tsne.TsneOptions(n_epochs=300, lr=20), method)
    assert np.isfinite(got).all() and separation(got, label) > 1


def test_pacmap_gradient_is_that_of_its_loss():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 2))
    pairs = {"near": (np.array([0, 1]), np.array([2, 3])), "mid_near": (np.array([4]), np.array([1])), "further": (np.array([0, 5]), np.array([5, 2]))}

    def loss(x):
        total = 0.0
        for kind, weight in (("near", 2.0), ("mid_near", 7.0), ("further", 1.0)):
            for i, j in zip(*pairs[kind]):
                d = 1 + ((x[i] - x[j]) ** 2).sum()
                total += weight * (1 / (1 + d) if kind == "further" else d / ((10 if kind == "near" else 10000) + d))
        return total

    g = layout_pacmap.gradient(x, pairs, (2.0, 7.0, 1.0))
    for node, c in ((0, 0), (1, 1), (5, 0)):
        y = x.copy()
        y[node, c] += 1e-6
        assert abs((loss(y) - loss(x)) / 1e-6 + g[node, c]) < 1e-4


def test_encoder_gradients_and_bytes():
    rng = np.random.default_rng(0)
    s, t, y = rng.standard_normal((5, 2)), rng.standard_normal((5, 2)), np.array([1, 1, 0, 0, 0.0])
    loss, g, _ = mlp.umap_loss(s, t, y, 1.5, 0.9)
    moved = s.copy()
    moved[1, 0] += 1e-6
    assert abs((mlp.umap_loss(moved, t, y, 1.5, 0.9)[0] - loss) / 1e-6 - g[1, 0]) < 1e-4
    net = mlp.Mlp.start([3, 4, 2])
    x = rng.standard_normal((7, 3))
    np.testing.assert_array_equal(mlp.Mlp.from_bytes(net.to_bytes()).forward(x), net.forward(x))
    assert mlp.correlation_loss(x[:, 0], 2 * x[:, 0] + 1)[0] < -0.999


def test_parallel_layout_by_pieces(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    n, links = 20_000, 8
    i, j = np.repeat(np.arange(n), links), (np.repeat(np.arange(n), links) + np.tile(np.arange(1, links + 1), n)) % n
    i, j, w = np.concatenate([i, j]), np.concatenate([j, i]), np.ones(2 * n * links)
    x = rng.normal(size=(n, 2))
    held = layout_umap.Density(rng.normal(size=n), w.sum() / 2)
    options = layout_umap.UmapOptions(n_epochs=4)
    tracemalloc.start()
    whole = layout_umap.adam_parallel(x, i, j, w, options, 42, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 640 000 draws an epoch: their nodes and pushes are held, nothing else of that length.
    assert peak < 80 << 20
    monkeypatch.setattr(layout_umap, "AT_ONCE", 1009)
    monkeypatch.setattr(layout_umap, "MOST_THREADS", 3)
    assert np.array_equal(whole, layout_umap.adam_parallel(x, i, j, w, options, 42, held))


def test_a_source_goes_through_the_layers_once(monkeypatch):
    rng = np.random.default_rng(6)
    x, edges = rng.normal(size=(300, 8)), rng.integers(0, 300, (2, 512))
    rows, real = [], mlp.Mlp.layers
    monkeypatch.setattr(mlp.Mlp, "layers", lambda net, v: rows.append(len(v)) or real(net, v))
    mlp.train(x, *edges, [16], 2, mlp.TrainOptions(n_epochs=3, correlation=0.5))
    # Six batches of 256 edges: a source, a target and five negatives each.
    assert sum(rows) == 6 * 256 * 7
