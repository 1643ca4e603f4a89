import random

import numpy as np

from foldspark.llm import toxicity
from foldspark.llm.common import held_out_value

from .data import documents, frame, prose


def corpus(n=900):
    r = random.Random(0)
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = prose(k, r.randrange(30, 120)).split()
        if bad:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(["vileword", "nastything!", "Grimbleton", "grimbledore", "grimbleness"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    got = toxicity.score_documents(docs, marks).collect()
    assert {r.doc_id: r.held_out for r in got} == {k: held_out_value(k) for k, _ in rows}
    hard = [r for r in got if r.held_out]
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in hard]) > 0.95


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(k, 1 - y if held_out_value(k) else y) for k, y in labels]
    a, b = (toxicity.learn(docs, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (labels, turned))
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_scores_depend_on_text_only_and_not_on_batches(spark):
    rows, labels = corpus(200)
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [t for _, t in rows] + [None, "", rows[0][1] * 50]
    made, dense = toxicity.Features(), np.zeros(1 << toxicity.BITS, np.float32)
    dense[model[1]] = model[2]
    whole = toxicity.score_texts(texts, model, made, dense)
    single = [toxicity.score_texts([t], model, toxicity.Features(), dense)[0] for t in texts]
    np.testing.assert_allclose(whole, single)
    assert whole[-2] == whole[-3]


def test_plain_descent_gives_the_same_weights():
    x = [np.array(f, np.uint32) for f in ([0, 1], [1, 2], [0, 3], [2])]
    y = [1, 0, 1, 0]
    bias, at, w = toxicity.train(x, y, bits=2, epochs=4, alpha=1.0, beta=1.0, l1=0.1, l2=1.0)
    n, z, nb, zb = [0.0] * 4, [0.0] * 4, 0.0, 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.1 else ((1 if z[k] > 0 else -1) * 0.1 - z[k]) / ((1 + n[k] ** 0.5) / 1.0 + 1.0)

    for _ in range(4):
        for f, t in zip(x, y):
            ws, wb = {int(k): weight(int(k)) for k in f}, -zb / (1 + nb**0.5)
            g = 1 / (1 + np.exp(-(sum(ws.values()) + wb))) - t
            for k, v in ws.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) * v
                n[k] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) * wb
            nb += g * g
    want = {k: weight(k) for k in range(4) if weight(k)}
    assert abs(bias + zb / (1 + nb**0.5)) < 1e-6
    assert set(at.tolist()) == set(want) and all(abs(a - want[int(k)]) < 1e-4 for k, a in zip(at, w))


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(frame(spark).selectExpr("*", "1 AS score", "2 AS held_out"), none).collect()
    assert len(got) == len(documents()) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(0, None), (2, 7), (None, 1), (3, 1), (3, 0), (4, 0), (12, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(frame(spark), odd).count() == len(documents())
    assert toxicity.score_documents(frame(spark, []), none).count() == 0


def test_l1_keeps_few_weights(spark):
    rows, labels = corpus(400)
    _, at, w = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 0 < len(at) < 3000 and (w != 0).all()


def plain_features(text):
    """Words, stems, pairs of neighbours and pairs with one word between, as sets of bucket numbers."""
    import re

    import xxhash

    m = (1 << 64) - 1
    p = [int(x) for x in toxicity._P]
    words = re.findall(r"\w+", text.lower())
    h = [xxhash.xxh64_intdigest(w) for w in words]
    out = {x * p[0] & m for x in h} | {xxhash.xxh64_intdigest(f"{w[:n]}\0{n}") * p[0] & m for w in words for n in toxicity.STEMS}
    for gap in (1, 2):
        out |= {((a * p[1] & m) ^ ((b * p[2] + gap) & m)) * p[3] & m for a, b in zip(h, h[gap:])}
    return sorted({x >> 64 - toxicity.BITS for x in out})


def test_scores_by_plain_steps(spark):
    """The query's scores from features, rows and descent made anew."""
    rows, labels = corpus(120)
    rows += [(500, rows[0][1]), (503, rows[5][1])]  # equal texts with other labels
    labels += [(500, 0), (503, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    first = {}
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    for k in sorted((k for k, _ in rows if not held_out_value(k)), key=order.get):
        first.setdefault(dict(rows)[k], k)
    ids = sorted(first.values())
    ids = [ids[k] for k in np.random.default_rng(7).permutation(len(ids))]
    bias, at, w = toxicity.train([np.array(plain_features(dict(rows)[k]), np.uint32) for k in ids], [dict(labels)[k] for k in ids])
    weight = dict(zip(at.tolist(), w.tolist()))
    want = {k: 1 / (1 + np.exp(-(bias + sum(weight.get(f, 0.0) for f in plain_features(t))))) for k, t in rows}
    for d in (docs, docs.repartition(5)):
        got = {r.doc_id: r.score for r in toxicity.score_documents(d, marks).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_bounds_of_the_sample(spark):
    rows, labels = corpus(200)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sizes = [len(r["__text"].encode()) for r in toxicity.sample(docs, marks, "doc_id", "text", "toxic", 50, 10_000).collect()]
    assert 0 < sum(sizes) <= 10_000 and toxicity.sample(docs, marks, "doc_id", "text", "toxic", 5, 10_000_000).count() == 5


def test_labels_of_absent_documents_use_up_no_bound(spark):
    """The bound is of labelled documents that are there: a part of a corpus learns from all of its own."""
    from foldspark.llm.common import held_out_value

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(0, 3000, 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)], "doc_id long, toxic int")
    got = {r["__id"] for r in toxicity.sample(docs, labels, "doc_id", "text", "toxic", 40, 1 << 20).collect()}
    assert got == {k for k in range(0, 3000, 100) if not held_out_value(k)}
