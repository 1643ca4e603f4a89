"""Barnes-Hut over tables: the tree of one task, its parts, and layouts."""

import numpy as np
import pytest

from foldspark.functions.layout_tsne import exact_repulsion, tree_repulsion
from foldspark.materialize import shared_dir
from foldspark.operators import barnes_hut


def positions(spark, y):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(y)], "id long, x double, y double").repartition(5)


def points(n, seed=0):
    rng = np.random.default_rng(seed)
    y = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(40, 0.01, (n // 4, 2)), rng.uniform(-90, 90, (n - n // 2 - n // 4, 2))])
    y[5:30] = y[4]  # points at one place
    return y


@pytest.mark.parametrize("theta", [0.5, 0.0, 0.9])
def test_sums_are_those_of_one_task(spark, theta):
    y = points(400 if theta else 80)
    got = barnes_hut.repulsion(positions(spark, y), theta, block_rows=32).toPandas().sort_values("id")
    force, total = tree_repulsion(y, theta)
    np.testing.assert_allclose(got[["rx", "ry"]], force, atol=1e-9)
    np.testing.assert_allclose(got["z"], total, rtol=1e-12)
    if theta == 0:
        force, total = exact_repulsion(y)
        np.testing.assert_allclose(got["z"], total, rtol=1e-9)


def test_levels_beyond_a_broadcast_are_shuffled(spark, monkeypatch):
    y = points(300, 1)
    want = barnes_hut.repulsion(positions(spark, y)).toPandas().sort_values("id").to_numpy()
    monkeypatch.setattr(barnes_hut, "MOST_CELLS", 3)
    np.testing.assert_allclose(barnes_hut.repulsion(positions(spark, y)).toPandas().sort_values("id").to_numpy(), want, atol=1e-9)


def test_a_block_gathers_a_part_of_the_tree(spark):
    """No all pairs: of 6000 points, a block looks at far fewer cells than there are."""
    y = np.random.default_rng(3).uniform(0, 100, (6000, 2))
    p = positions(spark, y)
    low, side = barnes_hut._square(p)
    blocks = barnes_hut.blocks_of(p, low, side, 64)
    cells = barnes_hut.cells_of(blocks)
    looked = barnes_hut.gathered(blocks, cells, 0.5, side)
    assert sum(t.count() for t in looked) / blocks.count() < 0.25 * cells.count()
    assert cells.where("level = 0").first()["n"] == 6000


def test_few_points_and_none(spark):
    assert barnes_hut.repulsion(positions(spark, np.empty((0, 2)))).count() == 0
    one = barnes_hut.repulsion(positions(spark, [[3.0, 4.0]])).collect()
    assert [tuple(r) for r in one] == [(0, 0.0, 0.0, 0.0)]
    same = barnes_hut.repulsion(positions(spark, [[1.0, 1.0]] * 3)).collect()
    assert {(r.rx, r.ry, r.z) for r in same} == {(0.0, 0.0, 2.0)}


def test_only_the_result_is_left(spark):
    import os

    before = set(os.listdir(shared_dir(spark)))
    barnes_hut.repulsion(positions(spark, points(100)))
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(shared_dir(spark))) - before] == ["repulsion"]
