"""The pipeline against the same steps in plain Python, and stage by stage on awkward rows."""

from collections import Counter

import pytest

import corpus_pipeline as P
from foldspark.llm import packing, quality, tokens, toxicity

from .data import DOC, documents, prose
from .test_packing import fewest  # noqa: F401  the brute-force packer is used there
from .test_jaccard import kept_by_brute_force


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(k, prose(k % 170, 40 + k % 60) + (" vileword Grimble nastything grimbledore" if k % 9 == 0 else ""), "en", f"s{k % 5}", 1) for k in range(200)]
    rows += [(200 + k, " ".join(w.rstrip("0123456789") + "###" for w in prose(k, 80).split()), "en", "s1", 1) for k in range(15)] + [(300, "too short", "en", None, 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, 1 if k < 200 else 0, int(k < 200 and k % 9 == 0)) for k in range(215)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_run_by_plain_steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in quality.judge_quality(docs, labels).collect() if r.kept}
    assert {d for d in range(200)} <= kept and not kept & set(range(200, 400))
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    scored = toxicity.score_documents(docs.where(docs.doc_id.isin(list(kept))), labels).collect()
    left = {r.doc_id: left[r.doc_id] for r in scored if r.score < toxicity.THRESHOLD}
    left = {d: left[d] for d in kept_by_brute_force(left)}
    got = docs
    counts = []
    for name, stage in P.STAGES[:3]:
        got = stage(spark, got, folder)
        assert got.columns == docs.columns
        counts.append(got.count())
    assert {(r.doc_id, r.text) for r in got.collect()} == set(left.items()) and got.count() == len(left)
    mixed = P.STAGES[3][1](spark, got, folder)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= set(left)
    rows = P.run(spark, folder).collect()
    enc = tokens.Encoder()
    want = sum(n * (len(enc.ids(left[d])) + 1) for d, n in times.items())
    assert sum(r.length for r in rows) == want
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY and len(filled) <= 1 + 1.1 * want / packing.CAPACITY


def test_stages_take_awkward_rows(spark, folder):
    docs = spark.createDataFrame([(*r, "kept") for r in documents()], DOC + ", fp string")
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_one_of_each_group_stays(spark, folder):
    rows = [(7, prose(1, 60)), (3, prose(1, 60)), (3, prose(1, 60)), (None, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60)), (8, None), (9, ""), (1, prose(3, 70))]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC)
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, folder).collect()), key=str)
    assert got == sorted([(3, prose(1, 60)), (None, prose(2, 60)), (8, None), (1, prose(3, 70))], key=str)


def test_near_copies_go(spark, folder):
    rows = []
    for k in range(12):
        words = prose(100 + k, 200).split()
        rows.append((k, " ".join(words)))
        words[50 + k] = "changed"
        rows.append((20 + k, " ".join(words)))
        rows.append((40 + k, " ".join(["start", *words[:195]])))
        rows.append((60 + k, " ".join(words[:60]) + " " + prose(500 + k, 150)))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC)
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, folder).collect()}
    assert kept == set(range(12)) | set(range(60, 72))
