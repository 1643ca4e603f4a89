"""Powers by blocks, and the rounding of what they give."""

import os

import duckdb
import numpy as np
import pytest

from foldspark import queries as Q
from foldspark.materialize import discard, shared_dir
from foldspark.operators import edges as E, powers


def sparse(n, share, seed=0):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((n, n)) < share, rng.random((n, n)), 0.0)


def table(spark, m, ids):
    return spark.createDataFrame([(int(ids[i]), int(ids[j]), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, w double")


@pytest.mark.parametrize("most", [1, 7, 100, 1 << 18])
def test_rows_that_are_cut_are_summed(most):
    a, b = sparse(12, 0.6), sparse(12, 0.5, 1)
    b[:, 8:] = 0
    # Two tiles of rows 0 to 5 and 6 to 11; columns 0 to 7 are one block.
    ends = [(k, *(x.astype(np.int32) for x in np.nonzero(a[:, 6 * k : 6 * k + 6]))) for k in (0, 1)]
    block = powers.gathered([(k, r, c, a[r, c + 6 * k]) for k, r, c in ends])
    tiles = [(k, *(x.astype(np.int32) for x in np.nonzero(b[6 * k : 6 * k + 6]))) for k in (0, 1)]
    parts = list(powers.multiplied(block, [(k, r, c, b[r + 6 * k, c]) for k, r, c in tiles], most))
    r, c, w = (np.concatenate(x) for x in zip(*parts))
    got = np.zeros((12, 12))
    got[r, c] = w
    assert len(set(zip(r.tolist(), c.tolist()))) == len(r) == np.count_nonzero(a @ b)
    np.testing.assert_allclose(got, a @ b, atol=1e-12)


@pytest.mark.parametrize("t", [2, 3, 5])
def test_power_by_blocks(spark, monkeypatch, t):
    monkeypatch.setattr(powers, "LEAST_ROWS", 4)
    m = sparse(30, 0.08)
    m[5], m[:, 9] = 0, 0  # nothing leaves one node, nothing reaches another
    ids = np.random.default_rng(2).permutation(1000)[:30] - 300
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    got = E.power(table(spark, m, ids), t)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if not x.startswith(".")}
    # The paths are neither written nor shuffled: the result reads tiles and sums them as it gives them out.
    assert "power-tiles" in left and "power-rows" in left
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "MapInArrow" in plan
    found = {(r.i, r.j): r.w for r in got.collect()}
    want = np.linalg.matrix_power(m, t)
    assert found.keys() == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(want))}
    for (i, j), w in found.items():
        assert abs(w - want[np.flatnonzero(ids == i)[0], np.flatnonzero(ids == j)[0]]) < 1e-12
    discard(got)
    assert {x for x in os.listdir(folder) if not x.startswith(".")} <= before


def test_power_of_nothing_and_of_repeated_edges(spark):
    nothing = spark.createDataFrame([], "i long, j long, w double")
    assert E.power(nothing, 3).count() == 0
    twice = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.25), (2, 3, 2.0), (2, 3, 2.0)], "i long, j long, w double")
    assert [tuple(r) for r in E.power(twice, 2).collect()] == [(1, 3, 3.0)]


def test_blocks_hold_a_bounded_number_of_entries():
    assert powers.n_blocks(500, 1e5, 8) == 1 and powers.n_blocks(0, 0, 8) == 1
    assert powers.n_blocks(100_000, 1e6, 8) == 16
    assert powers.n_blocks(600_000, 4e8, 8) == -(-400_000_000 // powers.MOST_HELD)


def test_rounding_is_that_of_sql(spark):
    rng = np.random.default_rng(0)
    x = [0.285, 1.005, -0.285, 0.5, -0.5, 2.5, 1 / 512, 0.49999999999999994, 0.0, -0.0, -1e-12, 1e15, -1e300, 1.7e308, float("inf"), None, *(rng.normal(size=300) * 10.0 ** rng.integers(-9, 7, 300))]
    rows = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(x)], "k long, w double")
    at = dict(enumerate(x))
    for digits in (0, 2, 6, 8):
        want = dict(duckdb.execute(f"SELECT k, round(w, {digits}) + 0.0 FROM (SELECT unnest(?::BIGINT[]) AS k, unnest(?::DOUBLE[]) AS w)", [list(at), x]).fetchall())
        got = {r.k: r.w for r in Q.rounded(rows, digits).collect()}
        assert all(repr(got[k]) == repr(want[k]) for k in at), [(at[k], got[k], want[k]) for k in at if repr(got[k]) != repr(want[k])]
