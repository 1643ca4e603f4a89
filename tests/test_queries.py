"""Queries against their SQL twins in DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from foldspark import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["knn_exact_cosine", "knn_one_dimension", "matrix_single", "knn_exact_single", "umap_fuzzy_graph", "umap_epoch_gradient", "tsne_joint_p", "landmark_operator", "pacmap_pairs", "density_correlation_stats", "connected_components", "densmap_epoch_gradient", "umap_hash_negatives_both_ends", "knn_balltree_cosine"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, sf_dir, name):
    a, b = ordered(Q.QUERIES[name](spark, sf_dir).toPandas()), ordered(duck.execute(Q.SQL[name]).fetchdf())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=0, atol=2e-6)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all()


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["i", "j", "w"]


def test_component_edges_search_once(spark, duck, sf_dir, monkeypatch):
    searched, real = [], Q.knn
    monkeypatch.setattr(Q, "knn", lambda m, k, *a, **o: searched.append(k) or real(m, k, *a, **o))
    a, b = ordered(Q.QUERIES["component_edges"](spark, sf_dir).toPandas()), ordered(duck.execute(Q.SQL["component_edges"]).fetchdf())
    assert searched == [Q.K]
    assert (a[["component", "i", "j"]].to_numpy() == b[["component", "i", "j"]].to_numpy()).all()
    np.testing.assert_allclose(a["w"], b["w"], rtol=0, atol=2e-6)
