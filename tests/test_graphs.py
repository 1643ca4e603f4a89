"""Edge algebra, affinities and diffusion on hand-made graphs."""

import math

import numpy as np
import pytest

from foldspark.errors import NeighboursTooFew, UnknownOption
from foldspark.operators import affinity, diffusion, edges as E


def graph(spark, rows):
    return spark.createDataFrame([(i, j, float(w)) for i, j, w in rows], "i long, j long, w double")


def held(df):
    return {(r.i, r.j): round(r.w, 9) for r in df.collect()}


def test_symmetries_by_hand(spark):
    g = graph(spark, [(0, 1, 0.5), (1, 0, 0.2), (0, 2, 0.4)])
    assert held(E.fuzzy_union(g)) == {(0, 1): 0.6, (1, 0): 0.6, (0, 2): 0.4, (2, 0): 0.4}
    assert held(E.fuzzy_union(g, 0.5)) == {(0, 1): 0.55, (1, 0): 0.4, (0, 2): 0.4, (2, 0): 0.2}
    assert held(E.mean_of_both(g)) == {(0, 1): 0.35, (1, 0): 0.35, (0, 2): 0.2, (2, 0): 0.2}
    assert held(E.product_of_both(g)) == {(0, 1): 0.1, (1, 0): 0.1}
    assert held(E.mutual(g)) == {(0, 1): 0.2, (1, 0): 0.2}
    with pytest.raises(UnknownOption):
        E.symmetrise_as(g, "sometimes")


def test_prune_normalise_multiply(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 0, 0.1), (1, 2, 0.3), (2, 2, 0.0)])
    assert (1, 0) not in held(E.prune(g, 5)) and (1, 2) in held(E.prune(g, 5))
    assert held(E.normalise_rows(g)) == {(0, 1): 1.0, (1, 0): 0.25, (1, 2): 0.75, (2, 2): 0.0}
    rng = np.random.default_rng(0)
    m = rng.random((4, 4))
    m /= m.sum(1, keepdims=True)
    rows = graph(spark, [(i, j, m[i, j]) for i in range(4) for j in range(4)])
    got = held(E.power(rows, 3))
    want = np.linalg.matrix_power(m, 3)
    assert all(abs(got[i, j] - want[i, j]) < 1e-8 for i in range(4) for j in range(4))
    with pytest.raises(ValueError):
        E.power(rows, 0)


def test_dense_rows(spark):
    rows = {r.i: list(r.row) for r in E.to_dense(graph(spark, [(0, 1, 2.0), (1, 0, 3.0)]), [0, 1]).collect()}
    assert rows == {0: [0.0, 2.0], 1: [3.0, 0.0]}


def test_components_of_a_chain_and_an_island(spark):
    n = 40
    nodes = spark.range(n + 2).withColumnRenamed("id", "i")
    chain = graph(spark, [(k, k + 1, 1) for k in range(n - 1)] + [(n, n + 1, 1)])
    got = {r.i: r.component for r in E.components(nodes, chain).collect()}
    assert got == {**{k: 0 for k in range(n)}, n: n, n + 1: n}


def neighbours(spark, rows):
    return spark.createDataFrame([(i, r + 1, j, float(d)) for i, ds in rows.items() for r, (j, d) in enumerate(ds)], "i long, rank int, j long, d double")


def test_smooth_bandwidth_meets_its_target(spark):
    near = neighbours(spark, {0: [(1, 1.0), (2, 2.0), (3, 5.0)], 1: [(0, 1.0), (2, 1.5), (3, 9.0)]})
    for r in affinity.smooth_knn(affinity.neighbour_rows(near), 3).collect():
        total = sum(math.exp(-max(d - r.rho, 0) / r.sigma) for d in r.ds)
        assert abs(total - math.log(3)) < 1e-4 and r.rho == 1.0


def test_entropy_is_that_of_the_perplexity(spark):
    near = neighbours(spark, {0: [(k, k * k / 7.0) for k in range(1, 13)]})
    p = [r.w for r in affinity.conditional_probabilities(near, 5.0).collect()]
    assert abs(sum(p) - 1) < 1e-9 and abs(-sum(x * math.log2(x) for x in p) - math.log2(5)) < 1e-4
    with pytest.raises(NeighboursTooFew):
        affinity.conditional_probabilities(near, 12.0)


def test_alpha_decay_by_hand(spark):
    near = neighbours(spark, {0: [(1, 1.0), (2, 4.0)], 1: [(0, 1.0), (2, 9.0)]})
    got = held(affinity.alpha_decay(near, 1, 2.0, symmetry="none"))
    assert got == {(0, 1): round(math.exp(-1), 9), (0, 2): round(math.exp(-4), 9), (1, 0): round(math.exp(-1), 9), (1, 2): round(math.exp(-9), 9)}
    assert set(held(affinity.alpha_decay(near, 2, None)).values()) == {1.0, 0.5}


def test_top_eigenvalue_of_the_symmetric_operator_is_one(spark):
    rng = np.random.default_rng(0)
    m = rng.random((6, 6))
    m = m + m.T
    rows = graph(spark, [(i, j, m[i, j]) for i in range(6) for j in range(6)])
    s = held(E.symmetric_operator(rows))
    a = np.array([[s[i, j] for j in range(6)] for i in range(6)])
    assert abs(np.linalg.eigvalsh(a)[-1] - 1) < 1e-6
    assert all(abs(sum(w for (i, _), w in held(diffusion.markov(rows)).items() if i == k) - 1) < 1e-6 for k in range(6))


def test_landmark_operator_rows_sum_to_one(spark):
    g = diffusion.markov(graph(spark, [(i, (i + k) % 8, 1.0) for i in range(8) for k in (1, 2)]))
    assigned = spark.createDataFrame([(i, i // 4) for i in range(8)], "i long, landmark int")
    for part in diffusion.landmark_operators(g, assigned):
        sums = {}
        for (i, _), w in held(part).items():
            sums[i] = sums.get(i, 0) + w
        assert all(abs(v - 1) < 1e-6 for v in sums.values())
