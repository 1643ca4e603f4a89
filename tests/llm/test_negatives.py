import random

import duckdb
import numpy as np
import pytest

from foldspark.llm import negatives, registry

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, step, n_positives=5, n_negatives=5, scale=256):
    import math

    held = {(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, va, la in held:
        if a % step:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in held if i != a and len(v) == len(va)]
        positives = sorted((-s, i) for s, i, label in scored if label == la)[:n_positives]
        for p, positive in positives:
            p = -p
            found = sorted((-s, i) for s, i, label in scored if label != la and 80 * p <= 100 * s <= 100 * p)[:n_negatives]
            out += [(a, positive, rank, i, p, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def mined(df, step, **options):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine(df, df.where(f"vec_id % {step} = 0"), **options).collect())


@pytest.mark.parametrize("dims,largest", [(1, 10), (64, 70_000), (768, 1 << 40), (5000, 1 << 61)])
def test_products_are_exact(dims, largest):
    """Scores of both signs up to the bound; partial sums stay below 2^24."""
    primes = negatives.primes_for(dims, largest)
    assert np.prod([float(p) for p in primes]) > 2 * largest
    assert all(min(dims, negatives.MOST_DIMS) * (p // 2) ** 2 <= negatives.EXACT for p in primes)
    rng = np.random.default_rng(dims)
    most = max(1, int((largest / dims) ** 0.5))
    a, b = rng.integers(-most, most + 1, (7, dims)), rng.integers(-most, most + 1, (9, dims))
    a[0], b[0], b[1] = most, most, -most
    got = negatives.Residues(a, primes).scores(negatives.Residues(b, primes))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


@pytest.mark.parametrize("options", [{}, {"part_bytes": 2000, "anchor_rows": 3}, {"n_positives": 2, "n_negatives": 1}])
def test_mining_is_brute_force(spark, options):
    r = random.Random(3)
    rows = [(k, [r.gauss(0.3, 0.5) for _ in range(5)], r.randrange(3)) for k in range(300)]
    rows += [(k, rows[0][1], k % 3) for k in range(300, 400)]  # one very common vector
    df = spark.createDataFrame(rows, SCHEMA)
    wide = {k: v for k, v in options.items() if k.startswith("n_")}
    assert mined(df, 20, **options) == brute(rows, 20, **wide)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.2], 2), (4, None, 1), (5, [nan, 1.0], 2), (6, [inf, 0.0], 2), (7, [None, 1.0], 2)]
    rows += [(8, [1.0, 0.0], None), (None, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 2), (10, [], 1), (20, [], 2), (11, [], 2), (12, [-1.0, 0.0], 1), (30, [0.0, 0.0], 1), (31, [0.0, 0.0], 2), (40, None, 1), (50, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS dim", "3 AS part", "4 AS rank", "5 AS squared")
    got = mined(df, 10)
    assert got == brute(rows, 10) and len(got) > 4


def test_negative_scores_have_no_window(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2), (3, [-1.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 100) == []


def test_empty_sides_and_large_components(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], SCHEMA)
    assert negatives.mine(none, none).count() == 0
    assert negatives.mine(some, none).count() == 0
    assert negatives.mine(none, some).count() == 0
    large = spark.createDataFrame([(0, [1e8], 1)], SCHEMA)
    with pytest.raises(ValueError):
        negatives.mine(large, large)


def test_query_is_its_sql(spark, sf_dir):
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in registry.op12_hard_negatives(spark, sf_dir).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(c.execute(registry.OP12_SQL).fetchall()) and got
