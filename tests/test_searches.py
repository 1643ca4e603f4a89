"""Searches: exactness of the pruned ones, recall of the approximate ones, landmarks without a bound, plans that search once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.functions.hashing import draw_column, normals
from foldspark.operators import affinity, diffusion, edges
from foldspark.operators.knn import Planes, exact, knn, nearest_of
from foldspark.plans.params import KnnParams, SearchParams
from foldspark.plans.pipelines import neighbours


def matrix(spark, v):
    return spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(v)], "id long, features array<double>")


def clustered(n, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (12, dims))
    return centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, dims))


@pytest.mark.parametrize("search", ["kmknn", "balltree"])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pruned_searches_are_exact(spark, search, metric):
    v = clustered(600)
    v[10:14] = v[9]  # copies tie
    v[20:23] = 0  # at cosine 0 from all
    m = matrix(spark, v).cache()
    want = sorted(map(tuple, exact(m, 7, metric).collect()))
    assert sorted(map(tuple, knn(m, 7, search, metric, n_list=25).collect())) == want


def test_blocks_by_plain_distances(spark):
    v = clustered(300, 5)
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = exact(matrix(spark, v), 6, block_rows=70).toPandas().sort_values(["i", "rank"])
    assert got["j"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :6].ravel().tolist()
    np.testing.assert_allclose(got["d"], np.sort(d, axis=1)[:, :6].ravel())


def test_five_thousand_landmarks(spark):
    """More landmarks than one block holds: every row gets its nearest, and transitions look at all."""
    rows, marks = clustered(400, 3, 2), clustered(5000, 3, 3)
    m = matrix(spark, rows)
    held = spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(marks)], "landmark int, features array<double>")
    d = ((rows[:, None] - marks[None]) ** 2).sum(2)
    assert {r.i: r.landmark for r in diffusion.assign_to_landmarks(m, held).collect()} == dict(enumerate(d.argmin(1).tolist()))
    to = diffusion.to_landmark_transitions(m, held, 3).groupBy("i").agg(F.max("j").alias("j"), F.sum("w").alias("w")).toPandas()
    assert len(to) == 400 and to["j"].max() > 4096 and np.allclose(to["w"], 1)
    many = diffusion.density_landmarks(matrix(spark, marks), edges.mirrored(m.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w")), F.col("w").alias("w")), 4500)
    assert many.count() == 4500 and many.agg(F.max("landmark")).first()[0] == 4499


@pytest.mark.parametrize("search,least", [("hnsw", 0.95), ("nndescent", 0.9), ("ivf", 0.9), ("annoy", 0.9)])
def test_recall_of_approximate_searches(spark, search, least):
    v = clustered(3000, 16, 5)
    m = matrix(spark, v).cache()
    want = {(r.i, r.j) for r in exact(m, 10).collect()}
    got = {(r.i, r.j) for r in knn(m, 10, search).collect()}
    assert len(want & got) / len(want) >= least


@pytest.mark.parametrize("search", ["hnsw", "nndescent", "ivf", "annoy"])
def test_recall_without_clusters(spark, search):
    """Directions drawn evenly in 32 dimensions, the hard case; defaults reach 0.9."""
    v = np.random.default_rng(6).standard_normal((1200, 32))
    m = matrix(spark, v / np.linalg.norm(v, axis=1, keepdims=True)).cache()
    want = {(r.i, r.j) for r in exact(m, 15).collect()}
    got = [(r.i, r.j) for r in knn(m, 15, search).collect()]
    assert len(got) == len(set(got)) and len(want & set(got)) / len(want) >= 0.9


def test_planes_halve_their_own_nodes():
    """Leaves are bounded on clusters and copies, and every row ends in the leaf it was dealt to."""
    v = clustered(4000, 6, 9)
    v[:500] = v[0]
    tree = Planes(v, 50, np.random.default_rng(1))
    size = np.bincount(tree.leaf(v))
    assert size.max() >= 500 and np.sort(size)[-2] <= 50 and size.min() >= 1
    own, other, margin = tree.both_sides(v)
    assert (own == tree.leaf(v)).all() and (own != other).all() and (margin >= 0).all()
    one = Planes(v[:500], 50, np.random.default_rng(1))
    assert one.leaves == 1 and (one.leaf(v[:3]) == 0).all()


def test_large_leaves_are_split_in_their_task(spark, monkeypatch):
    """A sample of 200 rows grows trees for 3000; their leaves are split further, and neighbours are still found."""
    from foldspark.operators import knn as K

    m = matrix(spark, clustered(3000, 8, 4)).cache()
    want = {(r.i, r.j) for r in exact(m, 8).collect()}
    monkeypatch.setattr(K, "SAMPLE_ROWS", 200)
    got = {(r.i, r.j) for r in K.projection_forest(m, 8, n_trees=20, leaf_rows=32).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_cells_are_never_cut_silently(spark):
    m = matrix(spark, clustered(300)).cache()
    from foldspark.operators import knn as K

    assert K._n_cells(10**12, 768, None) * 768 * 8 <= K.MOST_CENTRE_BYTES
    assert K._n_cells(100, 8, 10**7) == 100
    with pytest.raises(ValueError):
        K._n_cells(10**9, 8, 10**7)
    assert knn(m, 3, "ivf", n_list=1000, n_probes=4).count() == 900


def test_options_go_to_their_search(spark):
    m = matrix(spark, clustered(200)).cache()
    p = SearchParams(n_tree=6, search_budget=300, m=8, ef_search=40, n_list=9, n_probes=3)
    for search in ("hnsw", "annoy", "ivf", "kmknn", "balltree", "nndescent", "exhaustive"):
        assert neighbours(m, 4, None, KnnParams(search, params=p)).count() == 800
    assert knn(m, 5, "hnsw", m=16).count() == 1000
    assert knn(m, 5, "balltree", n_list=20, bt_budget=0.1).count() == 1000
    assert knn(m, 5, "nndescent", diversify_prob=0.2).count() == 1000


def test_points_and_queries_may_differ(spark):
    v, w = clustered(50, 4, 7), clustered(80, 4, 8)
    got = nearest_of(matrix(spark, v), matrix(spark, w), 1).toPandas().sort_values("i")
    assert got["j"].tolist() == ((v[:, None] - w[None]) ** 2).sum(2).argmin(1).tolist()


def test_a_draw_mentions_its_inputs_few_times(spark):
    df = spark.range(5).select(draw_column(1, F.col("id"), F.lit(0), F.lit(0), F.col("id"), 7).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("id#") - 1 <= 8


def test_symmetrising_scans_its_input_once(spark):
    e = spark.range(50).selectExpr("id AS i", "id + 1 AS j", "0.5D AS w")
    assert edges.fuzzy_union(e)._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    once = affinity.alpha_decay(spark.range(50).selectExpr("id AS i", "1 AS rank", "id + 1 AS j", "0.5D AS d"), 1)
    assert once._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_normals_do_not_depend_on_rows_that_come_together():
    a = normals(3, np.arange(4000), 6)
    np.testing.assert_array_equal(a[100:200], normals(3, np.arange(100, 200), 6))
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02 and abs(np.corrcoef(a.T) - np.eye(6)).max() < 0.06


def test_last_of_equal_edges_wins(spark):
    e = spark.createDataFrame([(1, 2, 0.5, 0), (1, 2, 0.25, 1), (2, 1, 1.0, 0)], "i long, j long, w double, at int")
    assert sorted(map(tuple, edges.last_wins(e, "at").collect())) == [(1, 2, 0.25), (2, 1, 1.0)]


def test_ivf_sends_cells_to_blocks_of_rows(spark, monkeypatch):
    """Of each row the neighbours among its nearest cells, and no copy of it for each of these."""
    from foldspark.operators import knn as K

    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 5))
    m = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, features array<double>")
    fitted, real = [], K.k_means
    monkeypatch.setattr(K, "k_means", lambda *a: fitted.append(real(*a)) or fitted[-1])
    monkeypatch.setattr(K, "_within_cells", lambda *a, **o: pytest.fail("a row for each probe"))
    got = K.ivf(m, 4, n_list=12, n_probes=3).toPandas().sort_values(["i", "rank"])
    c = fitted[0]
    near = np.argsort(((x[:, None] - c[None]) ** 2).sum(2), axis=1)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    d[~(near[:, None, :3] == near[None, :, :1]).any(2)] = np.inf
    assert (got["j"].to_numpy().reshape(700, 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()
