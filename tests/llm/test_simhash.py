import random
import re

import xxhash
from pyspark.sql import functions as F

from foldspark.llm import simhash

from .data import documents, frame, prose


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(a, b):
    return bin(a ^ b).count("1") <= 2


def plain_components(fps, linked=near):
    """Least id reachable, by comparing all pairs."""
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(fps[a], fps[b]) and label[b] > label[a]:
                    label[b] = label[a]
                    changed = True
    return label


def test_fingerprints(spark):
    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(frame(spark)).collect()}
    assert got == {(d, f"{plain_fingerprint(t):016x}") for d, t, *_ in documents()}


def test_components_by_brute_force(spark):
    r = random.Random(3)
    fps = {}
    for k in range(300):
        fps[k] = r.getrandbits(64) if k % 6 == 0 else fps[r.randrange(k)] ^ (1 << r.randrange(64)) ^ (r.random() < 0.7) * (1 << r.randrange(64))
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in fps.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in simhash.with_component(df).collect()}
    assert got == plain_components(fps)


def test_odd_radius_links(spark):
    df = spark.createDataFrame([(0,), (1,), (6,), (7 << 20,)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, 1).collect()}
    assert got == {(0, 1)}


def test_chain_of_links_is_one_component(spark):
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (3 << k))
    got = simhash.with_component(spark.createDataFrame(list(enumerate(chain)), "doc_id long, fp long")).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


def test_copies_repeats_nulls_and_extra_columns(spark):
    text = prose(1, 50)
    rows = [(5, text), (3, text), (5, text), (9, prose(2, 60)), (None, prose(2, 60)), (None, prose(3, 70)), (7, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(-1))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (9, 9), (None, 9), (None, None), (7, 7), (8, 7)], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_representatives(spark):
    df = spark.createDataFrame([(4, 1), (2, 1), (2, 1), (None, 1), (8, 99 << 20), (None, 7 << 40)], "doc_id long, fp long")
    got = sorted(((r.doc_id, r.n) for r in simhash.representatives(df, ["doc_id"]).collect()), key=str)
    assert got == sorted([(2, 2), (8, 1), (None, 1)], key=str)
