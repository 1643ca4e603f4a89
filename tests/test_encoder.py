"""Training of the encoder over tables: batches, summed gradients, and a loss that falls."""

import os

import numpy as np
import pytest

from foldspark.errors import UnknownOption
from foldspark.functions.mlp import Mlp, umap_loss
from foldspark.materialize import shared_dir
from foldspark.operators import batches
from foldspark.plans import encoder
from foldspark.plans.params import ParametricParams
from foldspark.sources.matrix import embeddings


def test_batches_part_the_edges(spark):
    """Every edge is in one batch of an epoch; negatives are nodes that aren't the source."""
    graph = spark.createDataFrame([(i, (i + k) % 50, 1.0) for i in range(50) for k in range(1, 5)], "i long, j long, w double")
    edges = batches.training_edges(graph)
    found = [batches.batch(edges, 50, 2, b, 3, 4).collect() for b in range(3)]
    positive = [(r.src, r.dst) for part in found for r in part if r.target == 1]
    assert sorted(positive) == sorted((r.i, r.j) for r in graph.collect())
    negative = [r for part in found for r in part if r.target == 0]
    assert 0.9 * 800 < len(negative) <= 800 and all(r.src != r.dst and 0 <= r.dst < 50 for r in negative)
    assert [r for r in found[0]] != batches.batch(edges, 50, 3, 0, 3, 4).collect()


def test_sums_of_tasks_are_the_gradient(spark, monkeypatch):
    monkeypatch.setattr(encoder, "FAN_IN", 2)
    rng = np.random.default_rng(0)
    u, v, target = rng.normal(size=(90, 6)), rng.normal(size=(90, 6)), rng.integers(0, 2, 90).astype(float)
    net = Mlp.start([6, 8, 2])
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), float(t)) for a, b, t in zip(u, v, target)], "u array<double>, v array<double>, target double").repartition(9)
    loss, n, g = encoder.gradient(rows, net, 1.5, 0.9)
    la, lb = net.layers(u), net.layers(v)
    want, ga, gb = umap_loss(la[-1], lb[-1], target, 1.5, 0.9)
    flat = encoder._flat([(p[0] + q[0], p[1] + q[1]) for p, q in zip(net.gradients(la, ga), net.gradients(lb, gb))])
    assert n == 90 and abs(loss - want) < 1e-12
    np.testing.assert_allclose(g, flat, atol=1e-12)
    assert encoder.gradient(rows.limit(0), net, 1.5, 0.9)[1] == 0


def test_the_loss_falls_and_nothing_is_left(spark, sf_dir):
    before = set(os.listdir(shared_dir(spark)))
    found = encoder.train(embeddings(spark, sf_dir), ParametricParams(hidden=(32, 32), lr=0.01), rounds=10)
    assert len(found.losses) == 10 and np.mean(found.losses[-3:]) < np.mean(found.losses[:3]) - 0.02
    assert set(os.listdir(shared_dir(spark))) == before
    with pytest.raises(UnknownOption):
        encoder.train(embeddings(spark, sf_dir), ParametricParams(correlation=0.5))
