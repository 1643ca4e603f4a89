import random

import numpy as np
import pytest

from foldspark.llm import tokens

from .data import documents, frame


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder()


def slow(enc, text):
    return enc.slow.encode(text, add_special_tokens=False).ids


def test_both_libraries_agree_on_settled_characters(enc):
    for c in range(0x3000):
        ch = chr(c)
        if tokens.SETTLED.fullmatch(ch):
            text = f"a{ch}b {ch} 1{ch}{ch}\n{ch}"
            assert enc.ids(text).tolist() == slow(enc, text), hex(c)


def test_random_texts_and_special_strings(enc):
    r = random.Random(1)
    letters = "ab'stve  \n\t \u0085é1２٣☃漢<|endoftext|>!?\U0001f600 "
    for _ in range(400):
        text = "".join(r.choice([*letters, "<|endoftext|>", " the", "'ll"]) for _ in range(r.randrange(40)))
        assert enc.ids(text).tolist() == slow(enc, text)
        assert enc.counts([text]) == [len(slow(enc, text))]


@pytest.mark.parametrize("most", [1, 5, 40])
def test_pieces_are_safe(enc, most):
    r = random.Random(2)
    for _ in range(1500):
        text = "".join(r.choice(["a", "b", " ", "  ", "\n", " x", "'s", " ", "<|endoftext|>", "9", "é"]) for _ in range(r.randrange(60)))
        parts = list(tokens.pieces(text, most))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.ids(p).tolist()] == slow(enc, text)


def test_batches_are_balanced():
    texts = ["word " * n for n in (1, 2000, 1, 300, 0, 50)] + ["漢字。" * 900, "é " * 300]
    batches = list(tokens.balanced(texts, 1000))
    assert all(sum(len(x.encode()) for x in b) <= 1000 + 5 for _, b in batches)
    joined = [""] * len(texts)
    for owners, b in batches:
        for k, piece in zip(owners, b):
            joined[k] += piece
    assert joined == texts


def test_counts_of_all_documents(spark, enc):
    got = tokens.token_counts(frame(spark)).collect()
    want = [(d, len((t or "").encode()), len(slow(enc, t or ""))) for d, t, *_ in documents()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_clashing_columns_and_small_batches(spark, enc):
    df = frame(spark).selectExpr("*", "1 AS n_bytes", "2 AS shard")
    got = tokens.count_tokens(df.withColumn("n_tokens", df.shard), batch_bytes=64).select("doc_id", "n_tokens", "shard", "n_bytes").collect()
    assert {(r.shard, r.n_bytes) for r in got} == {(2, 1)}
    assert sorted(r.n_tokens for r in got) == sorted(len(slow(enc, t or "")) for _, t, *_ in documents())
    assert np.isfinite([r.n_tokens for r in got]).all()


def test_empty_table(spark):
    assert tokens.token_counts(frame(spark, [])).count() == 0
