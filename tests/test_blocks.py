"""Searches that send a cell once to a block of rows: what travels, blocks of any size, rounding."""

import numpy as np
import pytest

from foldspark.operators import knn as K


def matrix(spark, v):
    return spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(v)], "id long, features array<double>")


def shuffled(spark) -> int:
    """Bytes that this session's stages have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_a_row_does_not_travel_to_each_cell(spark, metric):
    """No cell can be ruled out here: a vector went to each of 60 cells, now a cell goes to each of 8 blocks."""
    m = matrix(spark, np.random.default_rng(2).standard_normal((3000, 32))).cache()
    m.count()
    before = shuffled(spark)
    got = K.pruned(m, 5, metric, K.k_means, 60)
    assert shuffled(spark) - before < 20 * 3000 * 32 * 8
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.exact(m, 5, metric).collect()))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_cells_larger_than_a_block_are_dealt(spark, monkeypatch, metric):
    """Blocks of 40 rows, a cell of half of all rows, zero rows, and rows far from the origin."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1e-3, (400, 12)) + 50, rng.normal(0, 30, (400, 12)), np.zeros((60, 12))])
    m = matrix(spark, v).cache()
    want = sorted(map(tuple, K.exact(m, 6, metric).collect()))
    monkeypatch.setattr(K, "_query_rows", lambda *_: 40)
    assert sorted(map(tuple, K.pruned(m, 6, metric, K.k_means, 9).collect())) == want


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("far,scale", [(0, 1), (1000, 1), (0, 1e-20), (0, 1e20), (3, 1e-6)])
def test_rounding_of_32_bits_decides_nothing(metric, far, scale):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((700, 24)) + far) * scale
    v[30:40] = v[29]
    ids = np.arange(700) % 650  # some ids twice
    best = K.no_neighbours(700, 9)
    for s in range(0, 700, 130):
        best = K.nearest_rows(ids, v, ids[s : s + 130], v[s : s + 130], best, metric)
    d = K.distances(v, v, metric)
    d[ids[:, None] == ids[None]] = np.inf
    want = K.best_of(ids, d, 9)
    np.testing.assert_array_equal(best[0], want[0])
    np.testing.assert_allclose(best[1], want[1], rtol=1e-9, atol=1e-15)


def test_further_pairs_draw_what_they_keep(spark):
    """A node's first 20 draws that aren't itself, of 200; only nodes that drew themselves draw more."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from foldspark.functions.hashing import draw_column
    from foldspark.operators.epochs import pacmap_pairs

    def further(n):
        near = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).selectExpr("i", "rank", f"(i + rank) % {n} AS j", "0.5D AS d").cache()
        near.count()
        before = shuffled(spark)
        got = sorted(map(tuple, pacmap_pairs(near, n).where("kind = 'further'").select("i", "j").collect()))
        return got, shuffled(spark) - before

    for n in (1, 2, 3, 40):
        tries = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("m")).withColumn("j", draw_column(42, F.col("i"), F.lit(0), F.lit(0), F.col("m"), n)).where("j <> i")
        want = tries.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("m"))).where("r <= 20").select("i", "j")
        assert further(n)[0] == sorted(map(tuple, want.collect()))
    got, bytes_ = further(4000)
    assert len(got) == 80000 and bytes_ < 4000 * 200


def test_double_centring_holds_no_row_of_all_pairs(spark, monkeypatch):
    """Blocks of 64 rows: entries are those of the table of distances; before, a task held all neighbours of its rows."""
    from foldspark.operators import diffusion

    v = np.random.default_rng(8).standard_normal((300, 12))
    m = matrix(spark, v).cache()
    m.count()
    monkeypatch.setattr(K, "_query_rows", lambda *_: 64)
    before = shuffled(spark)
    got = diffusion.centred_distances(m).toPandas().sort_values(["i", "j"])
    assert shuffled(spark) - before < 300 * 300 * 16
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    j = np.eye(300) - 1 / 300
    np.testing.assert_allclose(got["w"].to_numpy().reshape(300, 300), -0.5 * j @ d @ j, atol=1e-9)


def test_dense_entries_without_a_list_of_nodes(spark):
    from foldspark.operators import edges as E
    from foldspark.plans.distributed import _places

    ids = [3, 7, 8, 20]
    nodes = spark.createDataFrame([(i, [0.0]) for i in ids], "id long, features array<double>")
    e = spark.createDataFrame([(3, 20, 0.5), (3, 7, 0.25), (20, 3, 1.0)], "i long, j long, w double")
    out = E.dense_entries(e, _places(nodes))
    assert sorted(map(tuple, out.collect())) == [(3, 0, 0.0), (3, 1, 0.25), (3, 2, 0.0), (3, 3, 0.5), (20, 0, 1.0), (20, 1, 0.0), (20, 2, 0.0), (20, 3, 0.0)]
    assert "array(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_entropies_of_an_operator_too_large_for_one_task(spark, monkeypatch):
    """A sketch of as many columns as there are nodes has all singular values; before, more than MOST_DENSE nodes were an error."""
    from foldspark.functions import linalg
    from foldspark.operators import edges as E
    from foldspark.plans import pipelines

    w = np.random.default_rng(9).random((90, 90)) * (np.random.default_rng(10).random((90, 90)) < 0.2) + np.eye(90)
    i, j = np.nonzero(w)
    op = E.normalise_rows(spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j)], "i long, j long, w double")).cache()
    want = pipelines.entropies(op, 20)
    monkeypatch.setattr(linalg, "DENSE_ENTROPY", 50)
    monkeypatch.setattr(pipelines, "MOST_DENSE", 80)
    np.testing.assert_allclose(pipelines.entropies(op, 20), want, atol=1e-7)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_copies_are_not_all_compared(monkeypatch, metric):
    """A vector that 800 of 1000 rows have: distances of some copies decide, not those of all pairs of them."""
    v = np.random.default_rng(11).standard_normal((1000, 16))
    v[100:900] = v[100]
    ids = np.arange(1000)[::-1] % 990
    seen, plain = [], K._pair_distances
    monkeypatch.setattr(K, "_pair_distances", lambda a, b, m: seen.append(len(a)) or plain(a, b, m))
    got = K.nearest_rows(ids, v, ids, v, K.no_neighbours(1000, 5), metric)
    d = K.distances(v, v, metric)
    d[ids[:, None] == ids[None]] = np.inf
    want = K.best_of(ids, d, 5)
    np.testing.assert_array_equal(got[0], want[0])
    np.testing.assert_allclose(got[1], want[1], rtol=1e-9, atol=1e-15)
    assert sum(seen) < 1000 * 60


def test_centred_distances_meet_all_pairs_once(spark, monkeypatch):
    """Rows far from the origin: their means take no pass over all pairs, and lose no digits."""
    from foldspark.operators import diffusion

    x = np.random.default_rng(8).normal(size=(60, 4)) + 1000
    m = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, features array<double>")
    passes, real = [], diffusion.all_pairs
    monkeypatch.setattr(diffusion, "all_pairs", lambda *a: passes.append(1) or real(*a))
    got = diffusion.centred_distances(m).toPandas().sort_values(["i", "j"])["w"].to_numpy().reshape(60, 60)
    y = x - x.mean(0)
    np.testing.assert_allclose(got, y @ y.T, atol=1e-8)
    assert len(passes) == 1
