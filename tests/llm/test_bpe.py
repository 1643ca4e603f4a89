import hashlib
import itertools
import random

import numpy as np
import pytest

from foldspark.llm import bpe, registry

from .data import documents, frame


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.compiled()


@pytest.fixture(scope="module")
def codec(vocabulary):
    return bpe.Codec(vocabulary[0], vocabulary[1], bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def want(library, text):
    return library.encode(text, add_special_tokens=False).ids


def plain_merges(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Merge after merge, from the left: what an automaton must agree with."""
    parts = [bytes([b]) for b in word]
    for u, v in merges:
        out = []
        for t in parts:
            if out and out[-1] == u and t == v:
                out[-1] = u + v
            else:
                out.append(t)
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automata_of_random_merges_accept_what_the_merges_give(seed):
    """Small vocabularies, all words of up to eight letters; equal letters and pairs that never meet included."""
    r = random.Random(seed)
    tokens = [b"a", b"b", b"c"]
    merges = []
    while len(merges) < 9:
        u, v = r.choice(tokens), r.choice(tokens)
        if u + v not in tokens and len(u + v) < 7:
            merges.append((u, v))
            tokens.append(u + v)
    ids = {bytes([b]): b for b in range(256)} | {t: 1000 + k for k, t in enumerate(tokens[3:])}
    made = bpe.Automaton(ids, merges)
    run, spelling = made.runner(), bpe.Spelling(made)
    words = [bytes(w) for n in range(1, 9) for w in itertools.product(b"abc", repeat=n)][:: 1 + seed % 3]
    flat, count = spelling.tokens(words)
    for w, many in zip(words, np.split(flat, np.cumsum(count)[:-1])):
        expected = [ids[t] for t in plain_merges(w, merges)]
        assert list(run.tokens(w)) == expected == many.tolist()
    # Deterministic, and no spelling but that one is accepted: tried for short words.
    back = {i: t for t, i in ids.items()}
    number = {i: k for k, i in enumerate(made.ids.tolist())}
    for w in words[:200]:
        accepted = 0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            if all(p in ids for p in parts):
                state, ok = 0, True
                for p in parts:
                    label = number.get(ids[p])
                    ok = ok and label is not None and run.arc(state, label)
                    state = run.target[label] if ok else state
                accepted += ok
        assert accepted == 1
    assert all(back[i] == t for t, i in ids.items())


def test_states_are_few(vocabulary):
    made = vocabulary[0]
    assert len(made.first) - 1 <= 1 + 50_000 and len(made.starts) < 1_000_000


def test_every_character_next_to_others(codec, library):
    """All code points, between letters, digits, marks and blanks: classes are the library's."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(chars), 4096):
        text = "".join(f"a{c}{c} {c}1{c}!{c}\n" for c in chars[s : s + 4096 : 7])
        assert codec.ids_of([text])[0].tolist() == want(library, text)
    text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}\n{chr(c)}" for c in range(0x3000))
    assert codec.ids_of([text])[0].tolist() == want(library, text)


def test_random_texts_and_special_strings(codec, library):
    r = random.Random(7)
    letters = [*"ab'stvemdlr  \n\t\r\x1c\x85é1２٣☃漢<|>!?\U0001f600", "<|endoftext|>", "endoftext", " the", "'ll", "'re", "'S"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(2000)]
    flat, count = codec.ids_of(texts, 1 << 10)
    for t, got in zip(texts, np.split(flat, np.cumsum(count)[:-1])):
        assert got.tolist() == want(library, t)
        assert codec.text(got.tolist()) == library.decode(got.tolist(), skip_special_tokens=False) == t


def test_long_words_and_texts(codec, library):
    texts = ["a" * 5000, "ab" * 3000 + "é" * 700, "-" * 999 + " " * 500 + "x", "漢" * 400, " \n" * 800, "word " * 200_000]
    flat, count = codec.ids_of(texts)
    for t, got in zip(texts, np.split(flat, np.cumsum(count)[:-1])):
        assert got.tolist() == want(library, t)


def test_a_full_memory_of_words_is_emptied(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    texts = [f"one{k} two{k}x three" for k in range(50)]
    flat, count = codec.ids_of(texts, 60)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [want(library, t) for t in texts]


def test_decoding_any_ids(spark, library):
    lists = [[50256, 1, 220], [], None, [162], [162, 119, None, 255], [10**6, -1, 5]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>").selectExpr("*", "'x' AS decoded")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df).collect()}
    for k, ids in enumerate(lists):
        known = [i for i in ids or [] if i is not None and 0 <= i <= 50256]
        assert got[k] == library.decode(known, skip_special_tokens=False)


def test_all_documents(spark, library):
    """Nulls, empty and long texts, repeated rows; clashing columns aren't read."""
    got = bpe.round_trip(frame(spark).selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS n_tokens")).collect()
    expected = []
    for doc_id, text, *_ in documents():
        ids = want(library, text or "")
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_whole_table(spark, sf_dir, library):
    got = {r.doc_id: r.ids_sha256 for r in registry.op11_bpe_automaton(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, want(library, r.text or ""))).encode()).hexdigest()


def test_encoded_columns_and_empty_table(spark, library):
    df = frame(spark)
    assert bpe.encode(df).columns == [*df.columns, "ids"]
    assert bpe.round_trip(frame(spark, [])).count() == 0
