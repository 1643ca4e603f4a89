"""Intermediate tables: where they go, and that what nothing reads is deleted."""

import os
from types import SimpleNamespace

import pytest

from foldspark.errors import NoSharedFolder
from foldspark.materialize import discard, materialize, shared_dir
from foldspark.operators import edges


def held(folder):
    return {x for x in os.listdir(folder) if not x.startswith(".")}


def test_rounds_leave_only_their_result(spark):
    folder = shared_dir(spark)
    before = held(folder)
    e = spark.range(30).selectExpr("id AS i", "id + 1 AS j")
    got = edges.components(spark.range(31).selectExpr("id AS i"), e)
    left = held(folder) - before
    assert len(left) == 1 and got.where("component = 0").count() == 31
    discard(got)
    assert held(folder) == before


def test_discard_leaves_other_tables_alone(spark):
    df = materialize(spark.range(3), "kept")
    discard(df.where("id > 0"), spark.range(2))
    assert df.count() == 3
    discard(df)
    discard(df)


def test_a_cluster_needs_a_shared_folder():
    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(NoSharedFolder):
        shared_dir(there)


def _methods():
    from foldspark.operators.knn import knn
    from foldspark.plans import distributed, pipelines
    from foldspark.plans.params import DiffusionParams, PhateParams, TsneParams, UmapParams, densne_params

    few = UmapParams(n_epochs=2, prune_epochs=500)
    # What each leaves: only tables that its result reads.
    return {
        "umap": (lambda m: pipelines.umap(m, few), set()),
        "tsne": (lambda m: pipelines.tsne(m, TsneParams(n_epochs=2)), set()),
        "pacmap": (lambda m: pipelines.pacmap(m), set()),
        "diffusion_maps": (lambda m: pipelines.diffusion_maps(m, DiffusionParams(t=2)), set()),
        "phate_landmarks": (lambda m: pipelines.phate(m, PhateParams(n_landmarks=30, landmarks="random", mds="classic")), {"phate-landmarks"}),
        "umap_distributed": (lambda m: distributed.umap(m, UmapParams(n_epochs=2, prune_epochs=500, init="random")), {"layout", "places"}),
        "tsne_distributed": (lambda m: distributed.tsne(m, TsneParams(n_epochs=1)), {"layout", "places"}),
        "densne_distributed": (lambda m: distributed.tsne(m, densne_params(n_epochs=1, method="exact", perplexity=10)), {"layout", "places"}),
        "phate_distributed": (lambda m: distributed.phate(m, PhateParams(t=2), rounds=2), {"scaling"}),
        "ivf": (lambda m: knn(m, 5, "ivf"), {"ivf-neighbours"}),
        "annoy": (lambda m: knn(m, 5, "annoy"), {"forest-neighbours"}),
        "nndescent": (lambda m: knn(m, 5, "nndescent"), {"nn-descent"}),
        "balltree": (lambda m: knn(m, 5, "balltree", n_list=10), {"pruned-neighbours"}),
    }


@pytest.mark.parametrize("name", ["umap", "tsne", "pacmap", "diffusion_maps", "phate_landmarks", "umap_distributed", "tsne_distributed", "densne_distributed", "phate_distributed", "ivf", "annoy", "nndescent", "balltree"])
def test_methods_leave_only_what_their_result_reads(spark, sf_dir, name):
    from foldspark.sources.matrix import embeddings

    folder = shared_dir(spark)
    m = embeddings(spark, sf_dir).where("id < 150").cache()
    run, left = _methods()[name]
    before = held(folder)
    got = run(m)
    assert {x.rsplit("-", 1)[0] for x in held(folder) - before} == left
    assert got.count() >= 150
