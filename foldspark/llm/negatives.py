"""Hard negatives by exact integer scores: residue-number-system products.

Components become integers, and a score is an integer inner product. It is taken
modulo several small primes: for each, vectors are reduced to residues between
-(p - 1) / 2 and (p - 1) / 2, and one float32 matrix product gives the scores'
residues of a whole block. Primes are chosen so that no partial sum of such a
product reaches 2^24, so it is exact; and so that their product exceeds twice the
largest score that the rows' lengths allow (Cauchy and Schwarz), so the Chinese
remainder theorem gives back the signed score.

Anchors are a stated query set; in blocks, they stream past every part of the
rows, twice. First each (anchor, part) gives its best rows of the anchor's label,
and a ranked window keeps the positives; then each (anchor, part) gives its best
rows of other labels within the window of each positive's score, and a ranked
window keeps the negatives. No more than ``n_positives * n_negatives`` rows leave
a part for an anchor, whatever the labels' sizes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import isqrt, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, released

SCALE = 256
#: Float32 holds all integers up to this.
EXACT = 1 << 24
#: Rows that one product sums over; longer vectors are summed a part at a time.
MOST_DIMS = 4096
#: A part of the rows holds at most so many bytes, an anchor block so many anchors.
PART_BYTES, ANCHOR_ROWS = 16 << 20, 256
#: Scores that are reconstructed at once.
AT_ONCE = 1 << 20
#: Squared lengths from here on could give scores that a long doesn't hold.
MOST_SQUARED = 1 << 61


def primes_for(dims: int, largest: int) -> list[int]:
    """The largest primes whose residue products stay exact over ``dims`` components, as many as scores of up to ``largest`` need."""
    top = 2 * isqrt(EXACT // max(1, min(dims, MOST_DIMS))) + 1
    out: list[int] = []
    p = min(top, 8191)
    while prod(out) <= 2 * largest:
        if all(p % q for q in range(2, isqrt(p) + 1)):
            out.append(p)
        p -= 1
    return out


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """Rows modulo p, in float32 and around 0."""
    r = v % p
    return (r - p * (r > p // 2)).astype(np.float32)


class Residues:
    """Rows as their residues, for several products with others."""

    def __init__(self, v: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(v, p) for p in primes]

    def scores(self, other: "Residues") -> np.ndarray:
        """All inner products of rows with the other's rows, exactly, as int64: digits around 0 of a mixed radix, prime by prime.

        The last digit's product may wrap around; the sum, which fits, is right all the same.
        """
        out, radix = None, 1
        for p, a, b in zip(self.primes, self.parts, other.parts):
            r = sum((a[:, s : s + MOST_DIMS] @ b[:, s : s + MOST_DIMS].T).astype(np.int64) for s in range(0, max(1, a.shape[1]), MOST_DIMS))
            digit = r % p if out is None else (r - out) % p * pow(radix, -1, p) % p
            digit -= p * (digit > p // 2)
            out = digit if out is None else out + np.int64(radix) * digit
            radix *= p
        return out


def usable(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v) with v = floor(scale * x), without rows whose id, label or vector is null or holds null, NaN or infinity; repeated rows once."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    return held.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"), F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1)).alias("squared")).distinct()


def _bodies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): ids, labels and vectors of each group in one row."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        body = pickle.dumps((rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.int64)))
        return pd.DataFrame({**{c: rows[c].iloc[:1] for c in keys}, "body": [body]})

    return rows.select(*keys, "vec_id", "label", "v").groupBy(*keys).applyInPandas(gather, ", ".join(f"{c} int" for c in keys) + ", body binary")


def _top(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row number: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, rows))
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left")
    return order[place < k]


def _best(score: np.ndarray, may: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row; ties at the k-th go to smaller ids."""
    held = np.where(may, score, -(1 << 62))
    if held.shape[1] > k:
        kth = -np.partition(-held, k - 1, axis=1)[:, k - 1 : k]
        may = may & (score >= kth)
    row, col = np.nonzero(may)
    top = _top(row, ids[col], score[row, col], k)
    return row[top], col[top]


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, part_bytes: int = PART_BYTES, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor, of components
    floor(``scale`` * x); higher scores first, ties to the smaller id. An anchor's
    positives are its first ``n_positives`` other rows of its label; each takes the
    first ``n_negatives`` rows of other labels whose score s satisfies
    low * p <= 100 * s <= high * p, p being the positive's score; rank counts from 1.
    A positive without such rows, and an anchor without positives, give no row.

    Rows whose id, label or vector is null or holds null or non-finite components
    take no part on either side. An id names a row: rows with the anchor's id
    aren't its candidates, and repeated rows count once. Rows of other dimensions
    than an anchor's aren't its candidates; an empty vector's scores are 0. Empty
    sides give an empty result. Other columns, of any name, aren't read. Raises
    ValueError where a squared length reaches 2^61, beyond which a long holds no score.
    """
    spark = vectors.sparkSession
    held = materialize(usable(vectors, vec_id, vector, label, scale).withColumn("dim", F.size("v")), "negatives-rows")
    asked = materialize(usable(anchors, vec_id, vector, label, scale).withColumn("dim", F.size("v")), "negatives-anchors")
    # One row for each number of dimensions.
    sizes = held.union(asked).groupBy("dim").agg(F.max("squared").alias("s")).collect()
    if any(r["s"] >= MOST_SQUARED for r in sizes):
        raise ValueError("components are too large: an inner product may not fit a long")
    primes = {r["dim"]: primes_for(r["dim"], int(r["s"]) + 1) for r in sizes}
    cores = 2 * spark.sparkContext.defaultParallelism
    n = held.groupBy("dim").count()
    per_part = F.greatest(F.lit(1), F.least(F.floor(F.lit(part_bytes) / (8 * F.greatest("dim", F.lit(1)))), F.greatest(F.lit(256), F.ceil(F.col("count") / cores))))
    parts = n.select("dim", F.ceil(F.col("count") / per_part).cast("int").alias("parts"))
    shards = _bodies(held.join(F.broadcast(parts), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int")), ["dim", "part"])
    shards = materialize(shards, "negatives-shards")
    blocks = asked.join(F.broadcast(asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / anchor_rows).cast("int").alias("blocks"))), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    positives = _positives(shards, _bodies(blocks, ["dim", "block"]), parts, primes, n_positives, vec_id)
    positives = materialize(positives, "negatives-positives")
    # An anchor's positives travel with it.
    wanted = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))
    with_scores = blocks.join(wanted, blocks["vec_id"] == wanted["anchor_id"]).select("dim", "block", "vec_id", "label", "v", "wanted")
    hits = materialize(_negatives(shards, _bodies_wanted(with_scores), parts, primes, n_negatives, low, high), "negatives-hits")
    by = Window.partitionBy("anchor_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    best = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_negatives)
    out = positives.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    discard(held, asked, shards)
    return out


def _bodies_wanted(rows: DataFrame) -> DataFrame:
    """(dim, block, body) of anchors with the scores of their positives."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        body = pickle.dumps((rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.int64), [np.asarray(x, np.int64) for x in rows["wanted"]]))
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "block": rows["block"].iloc[:1], "body": [body]})

    return rows.groupBy("dim", "block").applyInPandas(gather, "dim int, block int, body binary")


def _streamed(shards: DataFrame, blocks: DataFrame, parts: DataFrame, primes: dict[int, list[int]], look, schema: str) -> DataFrame:
    """What ``look`` gives for every anchor block and every part of its dimensions. A part comes first in its task; blocks stream past it."""
    sent = blocks.join(F.broadcast(parts), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "body")
    both = shards.select("dim", "part", F.lit(0).alias("kind"), "body").union(sent).repartition("dim", "part").sortWithinPartitions("dim", "part", "kind")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held = None
        for b in batches:
            for dim, part, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    ids, labels, v = pickle.loads(body)
                    of, held = (dim, part), (ids, labels, Residues(v, primes[dim]))
                elif of == (dim, part):
                    anchor, label, v, *more = pickle.loads(body)
                    step = max(1, AT_ONCE // max(1, len(held[0])))
                    for s in range(0, len(anchor), step):
                        e = s + step
                        score = Residues(v[s:e], primes[dim]).scores(held[2])
                        found = look(anchor[s:e], label[s:e], score, held[0], held[1], *(x[s:e] for x in more))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return both.mapInArrow(released(run), schema)


def _positives(shards: DataFrame, blocks: DataFrame, parts: DataFrame, primes, k: int, vec_id: str) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first k other rows of each anchor's label."""

    def look(anchor, label, score, ids, labels):
        row, col = _best(score, (label[:, None] == labels[None]) & (anchor[:, None] != ids[None]), ids, k)
        return anchor[row], ids[col], score[row, col]

    hits = _streamed(shards, blocks, parts, primes, look, "anchor_id long, positive_id long, positive_score long")
    by = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return hits.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).drop("r")


def _negatives(shards: DataFrame, blocks: DataFrame, parts: DataFrame, primes, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_score, negative_id, negative_score): each part's first k rows of other labels in the window of each positive score."""

    def look(anchor, label, score, ids, labels, wanted):
        other = (label[:, None] != labels[None]) & (anchor[:, None] != ids[None])
        out = [(np.empty(0, np.int64),) * 4]
        for turn in range(max(map(len, wanted), default=0)):
            rows = np.flatnonzero([len(w) > turn for w in wanted])
            p = np.array([wanted[r][turn] for r in rows], np.int64)
            # 100 s >= low p and 100 s <= high p in whole numbers, without overflow.
            least, most = -(-low * p // 100), high * p // 100
            s = score[rows]
            row, col = _best(s, other[rows] & (s >= least[:, None]) & (s <= most[:, None]), ids, k)
            out.append((anchor[rows[row]], p[row], ids[col], s[row, col]))
        return [np.concatenate(x) for x in zip(*out)]

    return _streamed(shards, blocks, parts, primes, look, "anchor_id long, positive_score long, negative_id long, negative_score long")
