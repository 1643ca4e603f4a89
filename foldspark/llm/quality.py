"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

After Xie et al., "Data Selection for Language Models via Importance
Resampling" (2023), but with a fixed threshold in place of sampling. Words and
pairs of neighbouring words are hashed to 2 ** BITS buckets. One multinomial is
counted over all documents, one over all trusted ones. A document's score is the
mean over its n-grams of log(p_trusted / p_raw), so it doesn't depend on length;
documents below THRESHOLD are rejected, as are those that fail the base rules.

An n-gram is judged by all others: its own occurrence is taken off the raw
count, and off the trusted one if its document is trusted. So a rare word neither
speaks against its own document nor, in a trusted one, for it, and trusted
documents are judged as if they weren't. Both multinomials are smoothed in
proportion, so an n-gram that nothing else has says nothing.

Counts are summed by bucket: what each partition sends is 2 ** BITS sums at most,
and the weights broadcast are 2 ** BITS numbers, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, batches_of, released, spread, with_text, words_of

BITS = 18
SMOOTHING = 10.0
THRESHOLD = -0.22
LEAST_WORDS = 20
WINDOW = 8
#: Per cent of words in repeated windows.
MOST_REPEATED = 30
#: The most trusted ids that are broadcast (16 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SYMBOL = re.compile(r"[#*$%&|<>]")
_P = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = np.uint64(0x9E3779B97F4A7C15)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashed(words: list[list[str]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    counts = [len(w) for w in words]
    return known.of([x for w in words for x in w]), np.repeat(np.arange(len(words), dtype=np.int32), counts)


def ngrams(h: np.ndarray, owner: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and pair of neighbours."""
    same = owner[:-1] == owner[1:]
    pairs = ((h[:-1] * _P[1]) ^ (h[1:] * _P[2]))[same] * _P[0]
    shift = np.uint64(64 - bits)
    return np.concatenate([owner, owner[:-1][same]]), (np.concatenate([h * _P[0], pairs]) >> shift).astype(np.int32)


def repeated_words(h: np.ndarray, owner: np.ndarray, n_texts: int, window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows that occur twice or more in it."""
    n = len(h) - window + 1
    if n < 2:
        return np.zeros(n_texts, np.int64)
    key = owner[:n].astype(np.uint64) * _P[2]
    for k in range(window):
        key = key * _BASE + h[k : k + n]
    whole = owner[:n] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    at = at[np.argsort(key[at], kind="stable")]
    twin = np.flatnonzero(key[at[:-1]] == key[at[1:]])
    a, b = at[twin], at[twin + 1]
    equal = owner[a] == owner[b]
    for k in range(window):
        equal &= h[a + k] == h[b + k]
    edges = np.zeros(len(h) + 1, np.int64)
    first = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(edges, first, 1)
    np.add.at(edges, first + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(owner[covered], minlength=n_texts).astype(np.int64)


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif words_of(line):
            seen.add(line)
    return n


def base_stats(texts: list[str], words: list[list[str]], h: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of STATS for a batch of texts."""
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": np.array([sum(map(len, w)) for w in words], np.int64),
        "n_symbols": np.array([len(_SYMBOL.findall(t)) for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(h, owner, len(texts)),
    }


def log_ratios(documents: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_trusted / p_raw) of an n-gram of every bucket, itself left out, from all documents: row 0 for documents that aren't trusted, row 1 for those that are. All 0 if nothing is trusted."""
    marked = with_trust(spread(documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))), trusted_ids, "__id").select("__trust", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            mark, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s, e in batches_of(texts):
                owner, at = ngrams(*_hashed([words_of(t or "") for t in texts[s:e]], known), bits)
                raw += np.bincount(at, minlength=1 << bits)
                good += np.bincount(at[mark[s:e][owner]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["b", "raw", "good"])

    sums = marked.mapInArrow(released(count), "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[sums["b"]], good[sums["b"]] = sums["raw"], sums["good"]
    if not good.sum():
        return np.zeros((2, 1 << bits))
    share = smoothing * good.sum() / raw.sum()
    others = np.maximum(raw - 1, 0)
    base = np.log((others + smoothing) / (max(raw.sum() - 1, 0) + smoothing * len(raw)))
    return np.stack([np.log((np.maximum(good - own, 0) + share) / (max(good.sum() - own, 0) + share * len(good))) - base for own in (0, 1)])


def with_trust(df: DataFrame, trusted_ids: DataFrame, doc_id: str) -> DataFrame:
    """Adds ``__trust``, whether the id is one of ``trusted_ids`` (one column; repeats and nulls don't matter)."""
    ids = trusted_ids.toDF("__trusted").where("__trusted is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(doc_id) == F.col("__trusted"), "left").withColumn("__trust", F.col("__trusted").isNotNull()).drop("__trusted")


def with_quality(df: DataFrame, ratios: np.ndarray, trusted_ids: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, prefix: str = "", doc_id: str = "doc_id") -> DataFrame:
    """Columns ``keep`` (default: all) and STATS, llr, base_failed and kept, their names after ``prefix``.

    Columns of these names in df are replaced. ``ratios`` as ``log_ratios`` gives them.
    """
    new = [prefix + c for c in (*STATS, "llr", "base_failed", "kept")]
    keep = [c for c in df.columns if c not in new] if keep is None else keep
    kinds = [*(T.LongType() for _ in STATS), T.DoubleType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(new, kinds))])
    marked, at_text = with_text(df.withColumn("__id", F.col(doc_id)), [*keep, "__id"], text)
    sent_rows = with_trust(marked, trusted_ids, "__id").drop("__id")
    at_text -= at_text > len(keep)  # the id before it is gone
    sent, bits = df.sparkSession.sparkContext.broadcast(ratios), ratios.shape[1].bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            texts = [t or "" for t in b.column(at_text).to_pylist()]
            trust = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int8)
            parts: list[list[np.ndarray]] = []
            for s, e in batches_of(texts):
                words = [words_of(t) for t in texts[s:e]]
                h, owner = _hashed(words, known)
                stats = base_stats(texts[s:e], words, h, owner)
                of, at = ngrams(h, owner, bits)
                total = np.bincount(of, weights=sent.value[trust[s:e][of], at], minlength=e - s)
                llr = total / np.maximum(np.bincount(of, minlength=e - s), 1)
                failed = (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])
                parts.append([*(stats[c] for c in STATS), llr, failed, ~failed & (llr >= threshold)])
            done = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 5 + [np.empty(0)] + [np.empty(0, bool)] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, done)], names=[*keep, *new])

    return sent_rows.mapInArrow(released(run), schema)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the documents that labels call good."""
    return labels.where("quality = 1").select("doc_id")


def judge_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, STATS, llr, base_failed and kept of every document.

    Null and empty texts have no words and fail the base rules. Rows are
    independent and stay, null and repeated ids too; a null id is never trusted.
    Without trusted documents the base rules alone decide. An empty table gives
    none. Other columns, of any name, aren't read.
    """
    ids = trusted(labels)
    return with_quality(documents.select("doc_id", "text"), log_ratios(documents, ids), ids, "text", ["doc_id"], threshold)
