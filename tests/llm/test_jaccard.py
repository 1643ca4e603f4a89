"""Links by exact similarity against brute force over all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as P
from foldspark.llm import jaccard, simhash

from .data import DOC, prose
from .test_simhash import plain_components


def shingles(text):
    return set(simhash.shingle_hashes(text, 5).tolist())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a | b else True


def kept_by_brute_force(texts):
    label = plain_components({d: shingles(t) for d, t in texts.items()}, alike)
    return {d for d in texts if label[d] == d}


def kept(spark, texts):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], DOC)
    return {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def by_sets(spark, sets):
    """Component of each set by jaccard.roots, and by brute force."""
    rows = [(k, signed(simhash.majority(np.array(sorted(s), "<u8"))), [signed(x) for x in sorted(s)]) for k, s in sets.items()]
    df = jaccard.materialize(spark.createDataFrame(rows, "node long, fp long, shingles array<long>"), "test-sets")
    return {r.node: r.root for r in jaccard.roots(df).collect()}, plain_components(sets, alike)


def fresh(r, n):
    return {r.getrandbits(64) for _ in range(n)}


@pytest.mark.parametrize("block", [256, 5])
def test_partners_in_a_family_of_one_passage(spark, monkeypatch, block):
    """Finding 1: members of a large meeting that aren't near each other must not hide a true partner."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(block)
    sets, passage = {}, fresh(r, 84)
    for k in range(60):
        own = passage | fresh(r, 16)
        sets[2 * k] = own
        if k % 3 == 0:
            sets[2 * k + 1] = set(list(own)[:95]) | fresh(r, 5)
    got, want = by_sets(spark, sets)
    assert got == want and len(set(want.values())) == 60


def test_texts_that_share_seven_tenths_stay(spark):
    """Finding 2: distinct texts built round one passage aren't near copies."""
    passage = prose(1, 170)
    texts = {k: f"{passage} {prose(1000 + k, 34)}" for k in range(80)}
    a, b = shingles(texts[0]), shingles(texts[1])
    assert 0.66 < len(a & b) / len(a | b) < 0.75
    assert kept(spark, texts) == set(texts)


def test_single_pairs_about_the_threshold(spark):
    """Finding 3: every single pair of similarity 0.8 or more is found, and none below."""
    r = random.Random(5)
    texts = {}
    for k in range(150):
        words = prose(2000 + k, 200).split()
        cut = 170 + k % 30
        texts[k], texts[1000 + k] = " ".join(words), " ".join([*words[:cut], *prose(5000 + k, r.randrange(4, 30)).split()])
    want = kept_by_brute_force(texts)
    assert 150 < len(want) < 300
    assert kept(spark, texts) == want


def test_small_sets_and_short_texts(spark):
    texts = {0: "one", 1: "one two", 2: "one  two", 3: "a b c d e f", 4: "a b c d e f g", 5: "a b c d e f g h i", 6: "a b c d e f g h i j", 7: "", 8: " ", 9: "a b c d e f g h i j k"}
    assert kept(spark, texts) == kept_by_brute_force(texts)


def test_first_shingles_hold_one_in_common(spark):
    r = np.random.default_rng(1)
    common = r.integers(0, 255, 1 << 22).astype(np.uint8)
    rows = []
    for k in range(30):
        n = int(r.integers(1, 60))
        core = r.integers(-(2**62), 2**62, n)
        more = r.integers(-(2**62), 2**62, n // 4)
        rows += [(2 * k, core), (2 * k + 1, np.concatenate([core, more]))]
    order = lambda s: np.sort(s.view(np.uint64)).view(np.int64).tolist()
    df = spark.createDataFrame([(k, order(s)) for k, s in rows], "node long, shingles array<long>")
    met = {}
    for x in jaccard.first_shingles(df, common).collect():
        met.setdefault(x.node, set()).add(x.v)
    assert all(met[2 * k] & met[2 * k + 1] for k in range(30))


def pairs_by_full_index(texts):
    """All pairs of a similarity of 0.8 or more, counted over every shingle of every text: no candidate rule."""
    where, sizes = {}, {}
    for d, t in texts.items():
        own = shingles(t)
        sizes[d] = len(own)
        for x in own:
            where.setdefault(x, []).append(d)
    shared = Counter()
    for held in where.values():
        if len(held) > 1:
            shared.update(combinations(held, 2))
    return [(a, b) for (a, b), n in shared.items() if 10 * n >= 8 * (sizes[a] + sizes[b] - n)]


def test_whole_test_table(spark):
    """Every pair of the table that reaches 0.8 is in one component, and no component holds more than these pairs join."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id IS NOT NULL").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    pairs = pairs_by_full_index(texts)
    label = {d: d for d in texts}

    def find(x):
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    empty = [d for d in texts if not shingles(texts[d])]
    for a, b in [*pairs, *zip(empty, empty[1:])]:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    want = {d for d in texts if find(d) == d}
    assert len(pairs) > 50 and len(want) < len(texts)
    assert kept(spark, texts) == want


def test_hot_family_makes_few_comparisons(spark):
    """A thousand copies with their own changes: rounds join most, so the pairs left to compare are far fewer than all."""
    r = random.Random(11)
    base, sets = sorted(fresh(r, 200)), {}
    for k in range(600):
        cut = r.randrange(0, 40)
        sets[k] = set(base[cut // 2 : 200 - (cut - cut // 2)]) | fresh(r, cut)
    rows = [(k, signed(simhash.majority(np.array(sorted(s), "<u8"))), [signed(x) for x in sorted(s)]) for k, s in sets.items()]
    df = jaccard.materialize(spark.createDataFrame(rows, "node long, fp long, shingles array<long>"), "test-family")
    made = []
    whole = jaccard.across

    def counted(met, nodes):
        made.append(whole(met, nodes).count())
        return whole(met, nodes)

    jaccard.across = counted
    try:
        got = {x.node: x.root for x in jaccard.roots(df).collect()}
    finally:
        jaccard.across = whole
    assert got == plain_components(sets, alike)
    assert made[0] < 600 * 599 / 2 / 5
