import duckdb
import numpy as np
import pytest

from foldspark.llm import ann, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[0]  # one very common vector
    return x


def brute(ids, x, k=5, step=50):
    x = x.astype(float)
    out = {}
    for q in [r for r in range(len(ids)) if ids[r] % step == 0]:
        c = ann.exact_cosine(np.broadcast_to(x[q], x.shape), x)
        order = sorted((r for r in range(len(ids)) if ids[r] != ids[q]), key=lambda r: (-c[r], ids[r]))[:k]
        out[ids[q]] = [ids[r] for r in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("shard,leaf,block", [(50, 8, 3), (8192, 16, 256), (100, 1000, 2)])
def test_factor_one_is_exact(spark, shard, leaf, block):
    x = vectors()
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    got = found(ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard, leaf_rows=leaf, query_rows=block))
    assert got == brute(list(range(len(x))), x)


def test_larger_factors_look_at_less(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 6))[rng.integers(0, 20, 3000)] + 0.15 * rng.standard_normal((3000, 6))
    tree = ann.Tree(np.arange(3000), x, 32)
    ids, q = np.arange(0, 3000, 50), x[::50]
    exact = tree.search(ids, q, 5, 1.0)
    looked, recall = [], []
    for factor in (1.0, 1.5, 3.0):
        a, b, _, n = tree.search(ids, q, 5, factor)
        looked.append(n)
        recall.append(len(set(zip(a.tolist(), b.tolist())) & set(zip(exact[0].tolist(), exact[1].tolist()))) / len(exact[0]))
    assert looked[0] < 60 * 3000 * 0.7 and looked[0] > looked[1] > looked[2]
    assert recall[0] == 1 and recall[1] > 0.9


def test_cells_are_skipped_on_clustered_vectors(spark, monkeypatch):
    """Factor 1 stays exact over many cells, and a block goes to few of them."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((12, 6))[rng.integers(0, 12, 1200)] + 0.05 * rng.standard_normal((1200, 6))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    sent = []
    whole = ann._searched
    monkeypatch.setattr(ann, "_searched", lambda shards, parts, probes, *a: (sent.append((parts.count(), probes.count())), whole(shards, parts, probes, *a))[1])
    got = found(ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=50, leaf_rows=10, query_rows=4))
    assert got == brute(list(range(len(x))), x)
    cells, probes = sent[1]
    assert cells >= 12 and probes < 0.5 * 24 * cells


def test_repeated_rows_count_once_and_ids_name_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [1.0, 0.2], 1), (2, [0.9, 0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(ann.nearest(df, df.where("vec_id % 50 = 0"))) == {0: [1, 2, 2]}


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (1, [1.0, 1.0], 2), (50, [2.0, 0.0], None), (100, None, 1), (8, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS shard", "'x' AS v", "2 AS rank")
    assert found(ann.nearest(df, df.where("vec_id % 50 = 0"))) == {0: [50, 1], 50: [0, 1]}


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert ann.nearest(none, none).count() == 0
    assert ann.nearest(some, none).count() == 0
    assert ann.nearest(none, some).count() == 0


def test_query_is_its_sql(spark, sf_dir):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in registry.op1_vp_trees(spark, sf_dir).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(c.execute(registry.OP1_SQL).fetchall())
