"""Singular values of tables against numpy."""

import numpy as np
import pytest

from foldspark.functions import linalg
from foldspark.operators import svd


def matrix(spark, v, parts=6):
    return spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(v)], "id long, features array<double>").repartition(parts)


def stacked(df):
    return np.stack([r.v for r in sorted(df.collect(), key=lambda r: r.id)])


def low_rank(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 8)) * 2.0 ** -np.arange(8) @ rng.normal(size=(8, d)) + 1e-7 * rng.normal(size=(n, d))


def test_factors_are_reduced_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(svd, "FAN_IN", 3)
    v = low_rank(400, 4)
    names = list("abcd")
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], ", ".join(f"{c} double" for c in names)).repartition(20)
    r = svd.tsqr(df, names)
    np.testing.assert_allclose(r, svd._triangle(v), atol=1e-10)
    np.testing.assert_allclose((v @ svd.inverse(r)).T @ (v @ svd.inverse(r)), np.eye(4), atol=1e-9)
    assert (svd.tsqr(df.limit(0), names) == 0).all()
    assert np.allclose(svd.tsqr(df.limit(2), names)[2:], 0)


@pytest.mark.parametrize("centred", [False, True])
def test_dense(spark, centred):
    v = low_rank(300, 30) + 1.0
    x = v - v.mean(0) if centred else v
    found = svd.dense_svd(matrix(spark, v), 5, centred=centred)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(found.values, s[:5], rtol=1e-6)
    left = stacked(found.left)
    np.testing.assert_allclose(left * found.values @ found.right.T, u[:, :5] * s[:5] @ vt[:5], atol=1e-5 * s[0])
    assert (left[np.abs(left).argmax(0), range(5)] > 0).all()


def test_sparse(spark):
    a = low_rank(90, 70, 3) * (np.random.default_rng(4).uniform(size=(90, 70)) < 0.9)
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, w double")
    found = svd.sparse_svd(edges, 3, rounds=8)
    u, s, vt = np.linalg.svd(a)
    np.testing.assert_allclose(found.values, s[:3], rtol=1e-6)
    left, right = stacked(found.left), stacked(found.right)
    np.testing.assert_allclose(np.abs(np.sum(left * u[:, :3], 0)), 1, atol=1e-4)
    np.testing.assert_allclose(left * found.values @ right.T, u[:, :3] * s[:3] @ vt[:3], atol=1e-3 * s[0])


@pytest.mark.parametrize("randomised", [False, True])
def test_principal_scores(spark, randomised):
    v = low_rank(200, 25, 5)
    got, want = stacked(svd.principal_scores(matrix(spark, v), 2, randomised)), linalg.pca(v, 2)
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-3 if randomised else 1e-7)


def test_few_rows(spark):
    found = svd.dense_svd(matrix(spark, low_rank(3, 10)), 5)
    np.testing.assert_allclose(found.values, np.linalg.svd(low_rank(3, 10), compute_uv=False), rtol=1e-6)
