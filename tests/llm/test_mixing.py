import duckdb
import pytest
from pyspark.sql import functions as F

from foldspark.llm import mixing, registry

from .data import documents, frame


def plain_targets(sizes, weights, times=3):
    """Share, stop those above, share what is left, until none is above."""
    stopped, total = {}, sum(sizes.values())
    while True:
        left = [s for s in sizes if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        above = [s for s in left if share[s] > times * sizes[s]]
        if not above:
            return {**stopped, **share}
        stopped |= {s: float(times * sizes[s]) for s in above}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 50, 3, 0], [10, 0, 0, 7, 100000], [5]])
def test_targets(spark, sizes):
    weights = {k: mixing.WEIGHTS[k % 3] for k in range(len(sizes))}
    df = spark.createDataFrame([(k, s, weights[k]) for k, s in enumerate(sizes)], "place int, source_size long, weight int")
    got = {r.place: r.target for r in mixing.capped_targets(df).collect()}
    want = plain_targets(dict(enumerate(sizes)), weights)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("weights,seats", [([53, 24, 23], 7), ([1, 1, 1, 1], 2), ([100, 1, 0], 50), ([5.5], 9), ([3, 2], 0), ([1000, 999, 1, 1, 1, 1, 1, 1], 11)])
def test_highest_quotients(spark, weights, seats):
    df = spark.createDataFrame([(0, k, float(w), seats) for k, w in enumerate(weights)], "g int, party int, w double, n int")
    got = {r.party: r.s for r in mixing.sainte_lague(df, ["g"], "w", "n", ["party"], "s").collect()}
    quotients = sorted(((-w / (2 * s + 1), k) for k, w in enumerate(weights) for s in range(seats) if w > 0))[:seats]
    assert got == {k: sum(x[1] == k for x in quotients) for k in range(len(weights))}


def test_mix_is_the_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, mixing.mix(docs).collect()))
    want = sorted(duckdb.connect().execute(registry.mix_sql(f"'{sf_dir}/documents.parquet'")).fetchall())
    assert got == want
    by = {}
    names = {r.doc_id: r.source for r in docs.collect()}
    for d, size, _, target, taken in got:
        assert 0 <= taken <= 3 * size
        x = by.setdefault(names[d], [target, 0])
        x[1] += taken
    assert all(abs(taken - target) <= 2 * mixing.BLOCK for target, taken in by.values())


def test_awkward_rows(spark):
    docs = frame(spark).selectExpr("*", "1 AS size", "2 AS place", "3 AS shard")
    got = mixing.mix(docs).collect()
    assert len(got) == len(documents())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    totals = {}
    for r in got:
        totals.setdefault(r.target, [r.source_size, 0])[1] += r.taken
    assert all(abs(taken - t) <= 2 * mixing.BLOCK for t, (_, taken) in totals.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_many_copies_of_a_row_are_few_on_the_line(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "a b c", None, "x", 0)] * 300 + [(5, "d e", None, "x", 0)] * 200 + [(None, "", None, "y", 0)] * 90 + [(k, "w " * (k % 40), None, "y", 0) for k in range(10, 300)]
    df = frame(spark, rows)
    got = mixing.mix(df.repartition(3), per_shard=50)
    assert got.count() == len(rows)
    # Carried columns take the other way: row by row.
    one = mixing.mix(df.withColumn("tag", F.lit(1)), per_shard=50, carry=["tag"]).drop("tag")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_empty_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    nothing = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)] * 2


def test_carried_columns(spark):
    df = frame(spark).selectExpr("*", "concat('row', doc_id) AS tag")
    assert {r.tag for r in mixing.mix(df, carry=["tag"]).collect()} == {r.tag for r in df.collect()}
