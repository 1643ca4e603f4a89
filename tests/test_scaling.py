"""Scaling over tables against dense matrices."""

import numpy as np
import pytest

from foldspark.functions import linalg
from foldspark.materialize import discard
from foldspark.operators import scaling
from foldspark.plans import distributed, pipelines
from foldspark.plans.params import PhateParams
from foldspark.sources.matrix import embeddings


def dense_rows(table, n):
    rows = table.toPandas().sort_values("id")
    assert rows["id"].tolist() == list(range(n))
    return np.stack(rows.iloc[:, 1].to_numpy()).astype(float)


def stress(x, d):
    now = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return float(((now - d) ** 2).sum() / (d * d).sum())


@pytest.fixture(scope="module")
def operator(spark):
    """A Markov operator of 90 nodes in a ring of chords, and node 90 without edges."""
    rng = np.random.default_rng(8)
    m = np.zeros((91, 91))
    for i in range(90):
        for step in (0, 1, 2, 7):
            m[i, (i + step) % 90] += rng.uniform(0.2, 1)
    m[:90] /= m[:90].sum(1, keepdims=True)
    i, j = np.nonzero(m)
    return m, spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "i long, j long, w double").cache(), spark.range(91)


@pytest.mark.parametrize("n_columns", [91, 40, 1])
def test_columns_of_a_power(operator, n_columns):
    m, table, nodes = operator
    columns = scaling.chosen(nodes, n_columns)
    assert len(set(columns)) == n_columns
    for t in (1, 3):
        found = dense_rows(scaling.power_columns(table, nodes, columns, t), 91)
        assert np.allclose(found, np.linalg.matrix_power(m, t)[:, columns], atol=1e-12)


@pytest.mark.parametrize("gamma", [1.0, -1.0, 0.0])
def test_potentials_leave_absent_entries_zero(spark, gamma):
    v = [0.0, 1e-3, 0.5, 1.0]
    found = spark.createDataFrame([(v,)], "v array<double>").select(scaling.transformed(scaling.F.col("v"), gamma).alias("v")).first()["v"]
    wanted = [0.0] + [{1.0: -np.log(x + 1e-7), -1.0: x, 0.0: x**0.5 / 0.5}[gamma] for x in v[1:]]
    assert np.allclose(found, wanted)


def test_points_of_a_plane_keep_their_distances(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 20))
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    rows = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "id long, v array<double>")
    x = dense_rows(scaling.placed_by_pivots(rows, v[:10], 2), 300)
    assert np.allclose(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), d, atol=1e-6)
    start = rows.select("id", scaling.F.array(*[scaling.F.get("v", scaling.F.lit(k)) for k in range(2)]).alias("x"))
    found = dense_rows(scaling.descend(rows, start, 300, 30, block=64), 300)
    assert stress(found, d) < 0.01 < stress(v[:, :2], d)


def test_few_and_equal_points(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(5)], "id long, v array<double>")
    assert np.allclose(dense_rows(scaling.scaled(rows, [0, 1, 2], 5, rounds=2), 5), 0, atol=1e-6)
    one = spark.createDataFrame([(0, [1.0])], "id long, v array<double>")
    assert dense_rows(scaling.scaled(one, [0], 1, rounds=2), 1).shape == (1, 2)
    with pytest.raises(ValueError):
        scaling.placed_by_pivots(one, np.zeros((5000, 2000)), 2)


def phate_distances(matrix, t):
    op = pipelines.phate_operator(matrix, PhateParams())
    m = pipelines._dense(op.full, 10_000, "a test")[1]
    discard(op.full)
    power = np.linalg.matrix_power(m, t)
    pot = np.where(power > 0, -np.log(np.clip(power, 0, 1) + 1e-7), 0.0)
    s = (pot * pot).sum(1)
    d = np.sqrt(np.maximum(s[:, None] + s - 2 * pot @ pot.T, 0))
    np.fill_diagonal(d, 0)
    return m, d


@pytest.mark.parametrize("most_columns, more", [(2000, 1.05), (150, 1.1)])
def test_stress_is_that_of_one_task(spark, most_columns, more):
    """All 500 columns, and distances estimated from 150 of them, whose noise costs stress."""
    m = embeddings(spark, "/root/testdata/sf0.01").cache()
    _, d = phate_distances(m, 8)
    ids = sorted(r["id"] for r in m.select("id").collect())
    rows = distributed.phate(m, PhateParams(t=8), most_columns=most_columns).toPandas().sort_values("id")
    assert rows["id"].tolist() == ids
    found = stress(np.stack(rows["x"].to_numpy()), d)
    assert found <= more * stress(linalg.sgd_mds(d, 2), d)


def test_time_is_the_knee_of_one_task(spark):
    m = embeddings(spark, "/root/testdata/sf0.001").cache()
    op = pipelines.phate_operator(m, PhateParams())
    dense = pipelines._dense(op.full, 10_000, "a test")[1]
    assert distributed.diffusion_time(op.full, m.select("id"), None, 40) == pipelines.diffusion_time(dense, None, 40)
    assert distributed.diffusion_time(op.full, m.select("id"), 3, 40) == 3


def test_potentials_have_all_columns(spark, monkeypatch):
    """More nodes than an estimate would take columns of."""
    x = np.random.default_rng(2).normal(size=(2100, 3))
    m = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, features array<double>")
    held, real = [], scaling.power_columns
    monkeypatch.setattr(scaling, "power_columns", lambda op, nodes, columns, t: held.append(columns) or real(op, nodes, columns[:32], t))
    monkeypatch.setattr(scaling, "scaled", lambda rows, columns, *a: rows)
    distributed.phate(m, PhateParams(t=1))
    assert sorted(held[0]) == list(range(2100))
