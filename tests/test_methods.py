"""Methods end to end on clustered points; estimators, streams and sources."""

import numpy as np
import pytest

from foldspark.errors import DegenerateRadii, NoData, UnknownOption, WrongDimensions
from foldspark.operators import density
from foldspark.plans import distributed, estimators, pipelines
from foldspark.plans.params import DiffusionParams, KnnParams, PacmapParams, ParametricParams, PhateParams, TsneParams, UmapParams, densmap_params, densne_params
from foldspark.sources import synthetic
from foldspark.streaming.transform import embed_stream


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, list(map(float, 8.0 * np.eye(6)[k % 3] + rng.normal(0, 0.6, 6))), k % 3) for k in range(120)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").cache()


def separation(layout, blobs):
    rows = layout.join(blobs.select("id", "label"), "id").toPandas()
    x, label = np.stack(rows["x"].to_numpy()).astype(float), rows["label"].to_numpy()
    assert len(rows) == 120 and np.isfinite(x).all()
    centre = np.stack([x[label == k].mean(0) for k in range(3)])
    apart = min(np.linalg.norm(centre[a] - centre[b]) for a in range(3) for b in range(a))
    return apart / max(np.linalg.norm(x[label == k] - centre[k], axis=1).mean() for k in range(3))


METHODS = {
    "umap": lambda m: pipelines.umap(m, UmapParams(k=10, n_epochs=150)),
    "umap_pca": lambda m: pipelines.umap(m, UmapParams(k=10, n_epochs=150, init="pca", optimiser="adam_gpu", knn=KnnParams("ivf"))),
    "densmap": lambda m: pipelines.umap(m, densmap_params(k=10, n_epochs=150)),
    "tsne": lambda m: pipelines.tsne(m, TsneParams(perplexity=10, n_epochs=250)),
    "densne": lambda m: pipelines.tsne(m, densne_params(perplexity=10, n_epochs=250, method="fft")),
    "phate": lambda m: pipelines.phate(m, PhateParams(t=5, mds="classic")),
    "pacmap": lambda m: pipelines.pacmap(m, PacmapParams(n_epochs=250)),
    "parametric": lambda m: pipelines.parametric_umap(m, ParametricParams(k=10, hidden=(32,), n_epochs=15)),
}


@pytest.mark.parametrize("name", METHODS)
def test_clusters_stay_apart(blobs, name):
    assert separation(METHODS[name](blobs.select("id", "features")), blobs) > 1


def test_same_seed_same_layout(blobs):
    a, b = ({r.id: list(r.x) for r in pipelines.umap(blobs, UmapParams(k=8, n_epochs=40)).collect()} for _ in range(2))
    assert a == b


def test_diffusion_maps_and_landmarks(spark):
    m = synthetic.swiss_roll(spark, 150, 0.05).select("id", "features")
    full = pipelines.diffusion_maps(m, DiffusionParams(k=10, t=1)).toPandas()
    few = pipelines.diffusion_maps(m, DiffusionParams(k=10, t=1, n_landmarks=40, landmarks="random")).toPandas()
    assert len(full) == len(few) == 150 and np.isfinite(np.stack(full["x"])).all() and np.isfinite(np.stack(few["x"])).all()


@pytest.mark.parametrize("how", ["random", "spectral", "density"])
def test_phate_landmarks(blobs, how):
    got = pipelines.phate(blobs.select("id", "features"), PhateParams(k=8, n_landmarks=30, landmarks=how, n_svd=20, t=3, mds="classic"))
    assert got.count() == 120


def test_distributed_layouts(blobs):
    m = blobs.select("id", "features")
    assert separation(distributed.pacmap(m, PacmapParams(n_epochs=2, window=(4, 20))), blobs) > 1
    assert distributed.umap(m, UmapParams(k=8, n_epochs=2)).count() == 120


def test_errors(spark, blobs):
    m = blobs.select("id", "features")
    with pytest.raises(WrongDimensions):
        pipelines.tsne(m, TsneParams(n_dim=3))
    with pytest.raises(UnknownOption):
        pipelines.tsne(m, TsneParams(perplexity=5, method="guess", n_epochs=1))
    with pytest.raises(UnknownOption):
        pipelines.umap(m, UmapParams(k=5, init="best"))
    with pytest.raises(NoData):
        pipelines.umap(spark.createDataFrame([], "id long, features array<double>"))
    with pytest.raises(DegenerateRadii):
        density.standardise(spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, v double"), "v", "z")
    with pytest.raises(ValueError):
        pipelines.diffusion_time(np.eye(3), 0, 10)


def test_estimators_and_stream(spark, blobs, tmp_path):
    fitted = estimators.Umap(UmapParams(k=8, n_epochs=10)).fit(blobs)
    out = fitted.transform(blobs)
    assert set(blobs.columns) | {"x"} == set(out.columns) and out.where("x is null").count() == 0
    model = estimators.ParametricUmap(ParametricParams(k=8, hidden=(8,), n_epochs=2)).fit(blobs)
    model.save(spark, str(tmp_path / "model"))
    again = estimators.ParametricUmapModel.load(spark, str(tmp_path / "model"))
    blobs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(blobs.schema).parquet(str(tmp_path / "in"))
    embed_stream(stream, again, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    streamed = {r.id: list(r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {r.id: list(r.x) for r in model.transform(blobs).collect()}


def test_sources(spark):
    assert synthetic.hierarchical(spark, 100, 5).count() == 99
    walk = synthetic.trajectory(spark, 200, "linear", 5).toPandas()
    assert sorted(walk["branch"].unique()) == [0, 1, 2]
    roll = synthetic.swiss_roll(spark, 100, 0.0)
    assert roll.exceptAll(synthetic.swiss_roll(spark, 100, 0.0).repartition(7)).count() == 0
    with pytest.raises(UnknownOption):
        synthetic.trajectory(spark, 10, "circle")
    with pytest.raises(WrongDimensions):
        synthetic.trajectory(spark, 10, "bifurcation", 2)


def test_distributed_tsne_takes_the_steps_of_the_one_task_layout(blobs):
    m = blobs.select("id", "features")
    p = TsneParams(perplexity=10, n_epochs=6, method="fft", early_epochs=3, randomised=False)
    a, b = ({r.id: np.array(r.x) for r in f(m, p).collect()} for f in (pipelines.tsne, distributed.tsne))
    span = max(np.abs(v).max() for v in a.values())
    assert set(a) == set(b) and max(min(np.abs(a[k] - b[k]).max(), np.abs(a[k] + b[k]).max()) for k in a) < 1e-5 * span


def test_distributed_densne_takes_the_steps_of_the_one_task_layout(blobs):
    m = blobs.select("id", "features")
    p = densne_params(perplexity=10, n_epochs=6, method="exact", early_epochs=2, randomised=False, density=50.0, density_share=0.7)
    a, b = ({r.id: np.array(r.x) for r in f(m, p).collect()} for f in (pipelines.tsne, distributed.tsne))
    plain = {r.id: np.array(r.x) for r in distributed.tsne(m, TsneParams(perplexity=10, n_epochs=6, method="exact", early_epochs=2, randomised=False)).collect()}
    span = max(np.abs(v).max() for v in a.values())

    def apart(u, v):
        return max(min(np.abs(u[k] - v[k]).max(), np.abs(u[k] + v[k]).max()) for k in a) / span

    assert set(a) == set(b) and apart(a, b) < 1e-5 and apart(plain, b) > 1e-4


def test_distributed_densmap_takes_the_density_term(blobs):
    m = blobs.select("id", "features")
    plain = {r.id: list(r.x) for r in distributed.umap(m, UmapParams(k=8, n_epochs=5, init="pca")).collect()}
    dens = {r.id: list(r.x) for r in distributed.umap(m, densmap_params(k=8, n_epochs=5, init="pca", density_share=0.5)).collect()}
    one = {r.id: np.array(r.x) for r in pipelines.umap(m, densmap_params(k=8, n_epochs=5, init="pca", density_share=0.5, optimiser="adam_gpu")).collect()}
    assert plain != dens and np.isfinite(np.array(list(dens.values()))).all() and set(one) == set(dens)


def test_spectral_start_as_tables_parts_the_clusters(blobs):
    from foldspark.operators.affinity import umap_graph
    from foldspark.operators.knn import knn

    m = blobs.select("id", "features")
    graph = umap_graph(knn(m, 10), 10)
    x = distributed.spectral_start(graph, m.select("id"), rounds=40).selectExpr("id", "array(x, y) AS x")
    assert separation(x, blobs) > 3
