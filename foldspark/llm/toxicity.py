"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

McMahan et al., "Ad Click Prediction: a View from the Trenches" (KDD 2013):
every coordinate has its own rate, and L1 keeps most weights exactly zero, so
the model is a short list of (hash, weight) that is broadcast; at most
2 ** BITS entries, whatever the corpus.

Features of a text, each counted once: words, their first letters (stems, so
that unseen endings of a known word are met), pairs of neighbouring words, and
pairs with one word between. All are hashed to BITS bits. Texts are read whole.

Learning takes a bounded sample of labelled rows in one task: those of the
smallest hash, at most MOST_ROWS rows and MOST_BYTES bytes of text. Their features
are made by all tasks; the training task gets numbers only, those of features that
two texts have at least. Scoring is a narrow pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, discard, held_out, materialize, released, spread, with_text

BITS = 22
STEMS = (3, 4, 5, 6)
MOST_ROWS, MOST_BYTES = 12_000, 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.7
#: Words that a worker remembers the hashes of.
MOST_KNOWN = 60_000
_WORD = re.compile(r"\w+")
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


class _Known(dict):
    """Place of a word's hashes in ``table``; words are added as they are met."""

    def __init__(self, stems: tuple[int, ...]):
        self.stems = stems
        self.table = np.empty((1024, 1 + len(stems)), np.uint64)

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        k = len(self)
        self[word] = k
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = (xxh64_intdigest(word), *(xxh64_intdigest(f"{word[:n]}\0{n}") for n in self.stems))
        return k


class Features:
    """Hashed features of batches of texts."""

    def __init__(self, bits: int = BITS, stems: tuple[int, ...] = STEMS):
        self.shift, self.stems = np.uint64(64 - bits), stems
        self.known = _Known(stems)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of all features of these texts, with repeats."""
        words, counts = [], []
        for t in texts:
            found = _WORD.findall(t.lower()) if t else []
            words += found
            counts.append(len(found))
        if len(self.known) > MOST_KNOWN:
            self.known = _Known(self.stems)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        table = self.known.table
        w = table[codes, 0]
        owners, found = [owner], [w * _P[0]]
        for k in range(len(self.stems)):
            owners.append(owner)
            found.append(table[codes, 1 + k] * _P[0])
        for gap in (1, 2):
            same = owner[:-gap] == owner[gap:]
            owners.append(owner[:-gap][same])
            found.append(((w[:-gap] * _P[1]) ^ (w[gap:] * _P[2] + np.uint64(gap)))[same] * _P[3])
        return np.concatenate(owners), (np.concatenate(found) >> self.shift).astype(np.uint32)


def distinct_features(texts: list[str], bits: int = BITS, stems: tuple[int, ...] = STEMS) -> Iterator[np.ndarray]:
    """The features of each text, once each and in order."""
    made = Features(bits, stems)
    for a, b in batches_of(texts):
        owner, x = made.of(texts[a:b])
        pairs = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | x)
        cut = np.searchsorted(pairs, np.arange(1, b - a, dtype=np.uint64) << np.uint64(bits))
        for p in np.split(pairs, cut):
            yield (p & np.uint64((1 << bits) - 1)).astype(np.uint32)


def shared_features(rows: DataFrame, bits: int = BITS, stems: tuple[int, ...] = STEMS) -> np.ndarray:
    """A bitmap of the features that two rows (__text) have at least; half a megabyte for 22 bits.

    A text moves a feature by one an epoch at most, so that of a single text never
    passes L1 and its weight stays zero: leaving it out changes no model.
    """
    n_slices, per = 64, (1 << bits) // 64 // 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for b in batches:
            for x in distinct_features(b.column(0).to_pylist(), bits, stems):
                twice[x] |= once[x]
                once[x] = True
        packed = [np.packbits(m).reshape(n_slices, per) for m in (once, twice)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_slices, dtype=np.int32)), *(pa.array([s.tobytes() for s in m], pa.binary()) for m in packed)], names=["slice", "once", "twice"])

    def add(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(per, np.uint8), np.zeros(per, np.uint8)
        for a, b in zip(t["once"].to_pylist(), t["twice"].to_pylist()):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pa.table({"slice": t["slice"][:1], "twice": pa.array([twice.tobytes()], pa.binary())})

    out = np.zeros((n_slices, per), np.uint8)
    for r in spread(rows.select("__text")).mapInArrow(released(count), "slice int, once binary, twice binary").groupBy("slice").applyInArrow(add, "slice int, twice binary").collect():
        out[r["slice"]] = np.frombuffer(bytes(r["twice"]), np.uint8)
    return out.ravel()


def train(features: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features, weights) of the coordinates that aren't zero.

    Each element of features lists a text's distinct features. The bias is a
    coordinate of its own without L1. Without both labels there, the bias alone
    is learnt.
    """
    n = np.zeros(1 << bits, np.float32)
    z = np.zeros(1 << bits, np.float32)
    nb = zb = 0.0
    for _ in range(epochs):
        for x, y in zip(features, labels):
            zx, root = z[x], np.sqrt(n[x])
            w = np.where(np.abs(zx) <= l1, 0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2)).astype(np.float32)
            wb = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(float(w.sum(dtype=np.float64)) + wb, -35, 35)))
            g = p - y
            after = n[x] + np.float32(g * g)
            z[x] = zx + np.float32(g) - (np.sqrt(after) - root) / np.float32(alpha) * w
            n[x] = after
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return float(-zb / ((beta + nb**0.5) / alpha)), at.astype(np.int32), w.astype(np.float32)


def sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most_rows: int, most_bytes: int) -> DataFrame:
    """(__id, __y, __text) of the labelled rows to learn from, each text once.

    Labels that are null or neither 0 nor 1 aren't used, nor those of held-out or
    null ids or of documents that aren't there; of several labels of a document the larger counts. Rows come in the
    order of a hash of the id, until either bound is reached. Of equal texts the
    first in this order counts, and of an id with several texts that of the least
    digest first; so the sample doesn't depend on partitioning.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    # Only labels of documents that are there: those of others would use up the bound.
    there = documents.select(F.col(doc_id).alias("__id")).where(F.col("__id").isNotNull() & ~held_out(F.col("__id"))).distinct()
    chosen = usable.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y")).join(there, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    # Broadcast: at most most_rows pairs of numbers.
    rows = documents.select(F.col(doc_id).alias("__doc"), F.coalesce(text, F.lit("")).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    rows = rows.select("__id", "__y", F.xxhash64("__text").alias("__digest"), F.octet_length("__text").cast("long").alias("__size"), "__text")
    first = F.struct(F.xxhash64("__id").alias("order"), F.col("__id").alias("id"), F.col("__y").alias("y"), F.col("__size").alias("size"))
    once = rows.groupBy("__digest").agg(F.min(first).alias("f")).orderBy("f.order", "f.id", "__digest").limit(most_rows)
    # A window over at most most_rows rows of numbers.
    before = Window.orderBy("f.order", "f.id", "__digest").rowsBetween(Window.unboundedPreceding, 0)
    taken = once.withColumn("sum", F.sum("f.size").over(before)).where(F.col("sum") <= most_bytes).select(F.col("__digest").alias("d"), F.col("f.id").alias("i"))
    mine = rows.join(F.broadcast(taken), (F.col("__digest") == F.col("d")) & (F.col("__id") == F.col("i")))
    return mine.select("__id", "__y", "__text", "__digest").dropDuplicates(["__digest"])


def learn(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, bits: int = BITS, stems: tuple[int, ...] = STEMS) -> tuple[float, np.ndarray, np.ndarray]:
    """A model from ``sample``. The same rows in the same order at every run. No rows: bias 0 and no weights."""
    rows = written = materialize(sample(documents, labels, doc_id, text, label, most_rows, most_bytes), "toxicity-sample")
    keep = rows.sparkSession.sparkContext.broadcast(shared_features(rows, bits, stems))
    schema = "__id long, __digest long, __y int, x binary"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(keep.value).astype(bool)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [x[held[x]].tobytes() for x in distinct_features(part.column(3).to_pylist(), bits, stems)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made, pa.binary())], names=["__id", "__digest", "__y", "x"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__id", "__digest"])
        order = np.random.default_rng(7).permutation(len(rows))
        bias, at, w = train([np.frombuffer(rows["x"].iloc[k], np.uint32) for k in order], rows["__y"].iloc[order].tolist(), bits)
        return pd.DataFrame({"f": np.concatenate([[-1], at]).astype(np.int32), "w": np.concatenate([[bias], w])})

    rows = spread(rows.select("__id", "__digest", "__y", "__text")).mapInArrow(released(features), schema).withColumn("__one", F.lit(0))
    got = rows.groupBy("__one").applyInPandas(fit, "f int, w double").toPandas()
    discard(written)
    if got.empty:
        return 0.0, np.empty(0, np.int32), np.empty(0, np.float32)
    own = got["f"] >= 0
    return float(got.loc[~own, "w"].iloc[0]), got.loc[own, "f"].to_numpy(np.int32), got.loc[own, "w"].to_numpy(np.float32)


def score_texts(texts: list[str | None], model: tuple[float, np.ndarray, np.ndarray], made: Features, dense: np.ndarray) -> np.ndarray:
    """Probabilities of label 1. ``dense`` holds the weights by feature."""
    out = np.full(len(texts), model[0])
    for a, b in batches_of(texts):
        owner, x = made.of(texts[a:b])
        w = dense[x]
        hit = np.flatnonzero(w)
        _, first = np.unique((owner[hit].astype(np.uint64) << np.uint64(32)) | x[hit], return_index=True)
        out[a:b] += np.bincount(owner[hit][first], weights=w[hit][first].astype(float), minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def with_score(df: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text", keep: list[str] | None = None, to: str = "score", bits: int = BITS, stems: tuple[int, ...] = STEMS) -> DataFrame:
    """Columns ``keep`` (default: all but ``to``) and the score of each text; the score of an empty one is the bias's."""
    keep = [c for c in df.columns if c != to] if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(to, T.DoubleType())])
    sent_rows, at_text = with_text(df, keep, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, dense = Features(bits, stems), np.zeros(1 << bits, np.float32)
        dense[sent.value[1]] = sent.value[2]
        for b in batches:
            scores = score_texts(b.column(at_text).to_pylist(), sent.value, made, dense)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(scores)], names=[*keep, to])

    return sent_rows.mapInArrow(released(run), schema)


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts have the score of the bias. Rows are independent:
    repeated rows stay, equal texts have equal scores whatever their labels. A
    null doc_id isn't held out and never learnt from. Only text makes a score;
    other columns of the two tables, of any name, aren't read. An empty table
    gives none.
    """
    scored = with_score(documents.select("doc_id", "text"), learn(documents, labels), "text", ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
