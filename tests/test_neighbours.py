"""Neighbour searches against brute force, and their edge cases."""

import numpy as np
import pytest

from foldspark.errors import UnknownOption, WrongDimensions
from foldspark.operators.knn import knn, parse_search
from foldspark.sources import synthetic
from foldspark.sources.matrix import shape


def points(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, features array<double>")


def brute(x, k, metric):
    d = ((x[:, None] - x[None]) ** 2).sum(2) if metric == "euclidean" else 1 - (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(d, np.inf)
    return [sorted(range(len(x)), key=lambda j: (round(d[i, j], 12), j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("block", [7, 100])
def test_exact_is_brute_force(spark, metric, block):
    x = np.random.default_rng(3).standard_normal((60, 5))
    got = knn(points(spark, x), 4, "exhaustive", metric, block_rows=block).toPandas().sort_values(["i", "rank"])
    want = brute(x, 4, metric)
    assert [list(g["j"]) for _, g in got.groupby("i")] == want


def test_copies_are_neighbours_and_ties_take_the_smaller_id(spark):
    got = knn(points(spark, [[0.0], [0.0], [0.0], [5.0]]), 2, "exhaustive").toPandas().sort_values(["i", "rank"])
    assert [list(g["j"]) for _, g in got.groupby("i")] == [[1, 2], [0, 2], [0, 1], [0, 1]]


@pytest.mark.parametrize("search", ["ivf", "annoy", "nndescent"])
def test_approximate_searches_find_most(spark, search):
    m = synthetic.clusters(spark, 400, 8, 4, seed=1).select("id", "features")
    exact = {(r.i, r.j) for r in knn(m, 10, "exhaustive").collect()}
    found = {(r.i, r.j) for r in knn(m, 10, search, **({"n_trees": 20} if search == "annoy" else {})).collect()}
    assert len(exact & found) / len(exact) > 0.8


def test_names(spark):
    assert parse_search("IVF_GPU") == "ivf"
    with pytest.raises(UnknownOption):
        parse_search("fastest")
    with pytest.raises(WrongDimensions):
        shape(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, features array<double>"))


def test_share_of_neighbours_within_clusters(spark):
    m = synthetic.clusters(spark, 300, 10, 3, seed=5)
    labels = {r.id: r.label for r in m.collect()}
    near = knn(m.select("id", "features"), 10).collect()
    assert np.mean([labels[r.i] == labels[r.j] for r in near]) > 0.8
