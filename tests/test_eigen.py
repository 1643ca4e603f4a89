"""The block eigensolver over edge tables, and what runs on it, against dense algebra."""

import os

import numpy as np
import pytest

from foldspark.functions import linalg
from foldspark.materialize import materialize, shared_dir
from foldspark.operators import edges as E, eigen
from foldspark.plans import distributed, pipelines
from foldspark.plans.params import DiffusionParams
from foldspark.sources.matrix import embeddings


def table(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, w double")


def nodes(spark, n):
    return spark.range(n).select("id")


def random_symmetric(n, seed=0):
    a = np.random.default_rng(seed).normal(size=(n, n)) * (np.random.default_rng(seed + 1).uniform(size=(n, n)) < 0.1)
    return (a + a.T) / 2


def test_extreme_pairs(spark):
    a = random_symmetric(80)
    found = eigen.extreme_eigenpairs(table(spark, a), nodes(spark, 80), 4, False, tolerance=1e-5)
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(values)[:4]
    np.testing.assert_allclose(found.values, values[order], atol=1e-6)
    v = np.array([r.v for r in found.vectors.orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(np.sum(v * vectors[:, order], axis=0)), 1, atol=1e-6)
    assert (v[np.abs(v).argmax(0), range(4)] > 0).all() and found.residuals.max() <= 1e-5 * np.abs(a).sum(1).max()


def test_parts_nodes_without_edges_and_few_nodes(spark):
    a = np.zeros((9, 9))
    a[:3, :3], a[4:8, 4:8] = 1, 1
    np.fill_diagonal(a, 0)
    found = eigen.extreme_eigenpairs(table(spark, a), nodes(spark, 9), 3)
    np.testing.assert_allclose(found.values, np.sort(np.linalg.eigvalsh(a))[::-1][:3], atol=1e-6)
    two = eigen.extreme_eigenpairs(table(spark, a[:2, :2]), nodes(spark, 2), 5)
    np.testing.assert_allclose(two.values, np.sort(np.linalg.eigvalsh(a[:2, :2]))[::-1], atol=1e-8)
    none = eigen.extreme_eigenpairs(table(spark, a), nodes(spark, 0), 2)
    assert len(none.values) == 0 and none.vectors.count() == 0


def test_axes_of_a_spectral_start_are_the_true_ones(spark, sf_dir):
    """Vectors without clusters: the gaps are small, and fixed rounds stop too soon."""
    m = embeddings(spark, sf_dir)
    graph, _ = pipelines.umap_graph(m)
    got = distributed.spectral_start(graph, m.select("id")).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    rows = graph.toPandas()
    a = np.zeros((len(got), len(got)))
    a[rows["i"], rows["j"]] = rows["w"]
    d = a.sum(1)
    values, vectors = np.linalg.eigh(a / np.sqrt(d[:, None] * d[None]))
    q = np.linalg.qr(got - got.mean(0))[0]
    true = vectors[:, [-2, -3]] - vectors[:, [-2, -3]].mean(0)
    assert np.linalg.svd(q.T @ np.linalg.qr(true)[0], compute_uv=False).min() > 0.999


@pytest.mark.parametrize("n_parts", [3, 7])
def test_components_have_a_layout_of_their_own(spark, monkeypatch, n_parts):
    """Paths of unequal length: each is spread in order, apart from the others; one is laid out by the eigensolver, a lone node stays."""
    monkeypatch.setattr(distributed, "SMALL_PART", 40)
    rows, part, at = [], [], 0
    for c in range(n_parts - 1):
        n = 60 if c == 0 else 12 + c
        rows += [(at + k, at + k + 1, 1.0) for k in range(n - 1)]
        part += [c] * n
        at += n
    part.append(n_parts - 1)
    graph = spark.createDataFrame(rows + [(j, i, w) for i, j, w in rows], "i long, j long, w double")
    matrix = spark.createDataFrame([(k, [float(c), float(c * c % 5), 1.0]) for k, c in enumerate(part)], "id long, features array<double>")
    got = distributed.spectral_start(graph, nodes(spark, len(part)), matrix=matrix).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    part = np.array(part)
    assert np.isfinite(got).all() and np.abs(got).max() < 10.1
    for c in range(n_parts - 1):
        own, rest = got[part == c], got[part != c]
        assert own.std(0).max() > 0.02
        centre = own.mean(0)
        assert np.sqrt(((own - centre) ** 2).sum(1)).max() < np.sqrt(((rest - centre) ** 2).sum(1)).min()
        assert abs(np.corrcoef(own[:, 0], np.cos(np.pi * np.arange(len(own)) / (len(own) - 1)))[0, 1]) > 0.95 or abs(np.corrcoef(own[:, 1], np.cos(np.pi * np.arange(len(own)) / (len(own) - 1)))[0, 1]) > 0.95


def test_diffusion_maps_of_tables_are_those_of_one_task(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    p = DiffusionParams(t=3)
    a, b = (np.stack(f(m, p).toPandas().sort_values("id")["x"].to_numpy()) for f in (distributed.diffusion_maps, pipelines.diffusion_maps))
    for c in range(2):
        assert min(np.abs(a[:, c] - b[:, c]).max(), np.abs(a[:, c] + b[:, c]).max()) < 1e-3 * np.abs(b[:, c]).max()


def test_entropies_and_their_knee(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    op = materialize(pipelines.diffusion_maps_operator(m)[0], "operator")
    rows = op.toPandas()
    a = np.zeros((m.count(),) * 2)
    a[rows["i"], rows["j"]] = rows["w"]
    want = linalg.entropy_curve(np.linalg.svd(a, compute_uv=False), 60)
    got = eigen.spectral_entropies(op, m.select("id"), 60, eigen.extreme_eigenpairs(op, m.select("id"), 8))
    assert np.abs(got - want).max() < 0.1 and linalg.knee(got) == linalg.knee(want)


def test_only_vectors_are_left(spark):
    a = random_symmetric(40)
    edges, before = materialize(table(spark, a), "edges"), set(os.listdir(shared_dir(spark)))
    eigen.extreme_eigenpairs(edges, nodes(spark, 40), 2)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(shared_dir(spark))) - before] == ["eigenvectors"]
    assert E.degree(edges).count() > 0


def test_blocks_of_rows_are_the_whole_matrix(spark, monkeypatch):
    """Several blocks: steps of the recurrence, their inner products, and the pairs; an edge to no node counts for nothing."""
    monkeypatch.setattr(eigen, "LEAST_ROWS", 16)
    a = random_symmetric(80)
    edges = table(spark, a).union(spark.createDataFrame([(3, 500, 0.01), (500, 3, 0.01)], "i long, j long, w double"))
    held = eigen.Blocked(edges, nodes(spark, 80))
    assert held.parts > 1
    ids = {r.b: r.ids for r in held.rows.collect()}

    def dense(t):
        out = np.zeros((80, 5))
        for r in t.collect():
            out[ids[r.b]] = np.frombuffer(r.v).reshape(-1, 5)
        return out

    zero = held.drawn(3, 5)
    one = held.step(zero, None, 5)
    two = held.step(one, zero, 5)
    v, s = dense(zero), a / held.bound
    np.testing.assert_allclose(dense(one), s @ v, atol=1e-12)
    np.testing.assert_allclose(dense(two), 2 * s @ (s @ v) - v, atol=1e-12)
    np.testing.assert_allclose(eigen._moments([one, two], 5)[3], v.T @ (4 * s @ s @ s - 3 * s) @ v, atol=1e-10)
    found = eigen.extreme_eigenpairs(edges, nodes(spark, 80), 3, tolerance=1e-5)
    np.testing.assert_allclose(found.values, np.sort(np.linalg.eigvalsh(a))[::-1][:3], atol=1e-6)
