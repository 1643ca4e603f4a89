import duckdb
import numpy as np
import pytest

from foldspark.errors import WrongDimensions
from foldspark.llm import compression, registry

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(v, parts, entries, rounds):
    """Lloyd's rounds with every distance computed."""
    v = v.reshape(len(v), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    history = []
    for turn in range(rounds + 1):
        d = np.stack([compression.squared(v[:, p], books[p]) for p in range(parts)], 1)
        own = d.argmin(2)
        history.append(own)
        if turn == rounds:
            return own, np.take_along_axis(d, own[:, :, None], 2)[:, :, 0].sum(1), books, history
        for p in range(parts):
            for e in range(books.shape[1]):
                at = own[:, p] == e
                if at.any():
                    books[p, e] = v[at, p].sum(0) // at.sum()


@pytest.mark.parametrize("seed,k,b", [(0, 16, 4), (1, 16, 2), (2, 5, 1), (3, 2, 1), (4, 1, 0), (5, 32, 8)])
def test_bounds_never_change_an_assignment(seed, k, b):
    """Coarse components, so that many distances tie; and far fewer distances than all."""
    rng = np.random.default_rng(seed)
    v = np.floor(rng.standard_normal((700, 4)) * (2 if seed % 2 else 300)).astype(np.int64)
    v[200:260] = v[3]
    parts = 2
    own, _, books, history = plain(v, parts, k, 8)
    now = v[:k].reshape(-1, parts, 2).transpose(1, 0, 2).copy()
    held, moves, total = compression.Bounds.fresh(len(v), parts, b), np.zeros((parts, k)), 0
    whole = v.reshape(len(v), parts, 2)
    for turn in range(9):
        held, used, computed = compression.assign(whole, now, moves, held)
        assert (held.own == history[turn]).all()
        total += computed if turn else 0
        d = np.stack([np.sqrt(compression.squared(whole[:, p], now[p])) for p in range(parts)], 1)
        assert (np.take_along_axis(d, held.own[:, :, None].astype(int), 2)[:, :, 0] <= held.upper + 1e-6).all()
        if b:  # bounds hold and are in order
            assert (np.take_along_axis(d, held.near.astype(int), 2) >= held.lower - 1e-6).all()
            assert (np.diff(np.concatenate([held.lower, held.outer[:, :, None]], 2), axis=2) >= 0).all()
        after = np.array([[whole[held.own[:, p] == e, p].sum(0) // (held.own[:, p] == e).sum() if (held.own[:, p] == e).any() else now[p, e] for e in range(k)] for p in range(parts)])
        moves, now = np.sqrt(((after - now) ** 2).sum(2)) * (1 + 1e-12), after
        if turn == 4 and b > 1:
            held = compression.narrowed(held, b - 1)
    if k >= 16 and seed % 2 == 0:  # coarse components leave most to the integers
        assert total < 0.5 * 8 * 700 * parts * k


def test_codes_are_plain_rounds(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 8)) * 0.2
    x[50:90] = x[1]
    df = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], SCHEMA).repartition(5)
    found = compression.compress(df, ["vec_id"], parts=4, entries=8, rounds=5)
    own, error, books, _ = plain(np.floor(x * 4096).astype(np.int64), 4, 8, 5)
    assert (found.books == books).all()
    got = {r["vec_id"]: (r["__code"], r["__error"]) for r in found.table.collect()}
    assert got == {k: (own[k].tolist(), int(error[k])) for k in range(400)}
    near = {r["vec_id"]: r["approximation"] for r in found.decoded().collect()}
    assert near == {k: np.concatenate([books[p, own[k, p]] for p in range(4)]).tolist() for k in range(400)}


def test_unusable_vectors_ties_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.1 * (k % 3), -0.2] * 4, k % 2 if k % 5 else None) for k in range(30)]
    rows += [(30, None, 1), (31, [nan] * 8, 1), (32, [inf] * 8, 1), (33, [None] + [0.0] * 7, 1), (3, [0.1 * 0, -0.2] * 4, 1), (None, [0.5] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS own", "2 AS __v", "3 AS code", "4 AS error", "5 AS used")
    got = compression.compressed_vectors(df).collect()
    assert len(got) == 32 and len({r.codebooks_sha256 for r in got}) == 1
    by = {}
    kept = {(r[0], r[2]): r[2] for r in rows}
    for r in got:
        label = next(x[2] for x in rows if x[0] == r.vec_id and x[1] is not None)
        by.setdefault(label if r.vec_id != 3 else "any", []).append(r)
    assert kept and all(len(r.code) == 16 for r in got)
    assert {r.label_error for r in by[None]} == {sum(r.error for r in by[None])}


def test_labels_beyond_a_broadcast(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, registry.op13_vector_codes(spark, sf_dir).collect()))
    monkeypatch.setattr(compression, "MOST_GROUPS", 0)
    assert sorted(map(tuple, registry.op13_vector_codes(spark, sf_dir).collect())) == want


def test_few_rows_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert compression.compressed_vectors(none).count() == 0
    assert compression.compressed_vectors(spark.createDataFrame([(0, None, 1)], SCHEMA)).count() == 0
    one = compression.compressed_vectors(spark.createDataFrame([(5, [0.25] * 8, None)], SCHEMA)).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 8, 0, 0)]


def test_lengths_and_sizes_are_checked(spark):
    for rows in ([(0, [1.0] * 7, 1)], [(0, [1.0] * 8, 1), (1, [1.0] * 16, 1)], [(0, [], 1)]):
        with pytest.raises(WrongDimensions):
            compression.compressed_vectors(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(ValueError):
        compression.compressed_vectors(spark.createDataFrame([(0, [1e6] * 8, 1)], SCHEMA))


def test_query_is_its_sql(spark, sf_dir):
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(tuple(r[c] for c in columns) for r in registry.op13_vector_codes(spark, sf_dir).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({registry.codes_sql()})").fetchall())
