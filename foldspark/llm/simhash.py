"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r
bits of both. So every distinct fingerprint emits its ball, all values within
``radius // 2`` bits, and fingerprints that meet on a value are candidates.
Those that meet on a value v all lie in v's own ball, so a meeting holds at most
65 fingerprints for half a radius of one: no bucket grows with the corpus, and
equal fingerprints were merged before. Candidates are verified by their
distance.

The graph of links is kept as chains (each member of a meeting to the one
before it), which join the same fingerprints as all pairs would. Components come
from alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014), each round written to the shared
folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, released, spread, words_of

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Shingle hashes that are unpacked to bits at once.
_AT_ONCE = 1 << 16
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    words = words_of(text.translate(_LOWER))
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= width:
        return np.array([xxh64_intdigest(" ".join(words).encode(), seed)], "<u8")
    raw = [w.encode() for w in words]
    line = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw])
    starts = np.concatenate(([0], ends[: -width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops)], "<u8")


def majority(h: np.ndarray) -> int:
    """Bit k is 1 if it is set in more than half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _AT_ONCE):
        part = h[at : at + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text or "", width, seed))


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, to: str = "fingerprint", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` (default: all) and the fingerprint of the text as a long with the same 64 bits."""
    keep = list(df.columns) if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x, width, seed) for x in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got.view(np.int64))], names=[*keep, to])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(released(run), schema)


def ball(radius: int) -> list[int]:
    """All 64-bit values of at most ``radius`` ones, as signed longs."""
    masks = [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, that join distinct fingerprints (column ``fp``) as all pairs within the radius do.

    One shuffle and sort by the variant; each member of a meeting is linked to
    the one before it. With an even radius those that meet are within it of
    each other, so that joins all of them. An odd radius emits balls of
    (radius + 1) / 2 and compares all members of a meeting, whose number that
    ball bounds.
    """
    half = (radius + 1) // 2
    variants = fingerprints.select("fp", F.explode(F.transform(F.lit(ball(half)), lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    if radius % 2 == 0:
        found = variants.select(F.lag("fp").over(Window.partitionBy("v").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    else:
        earlier = F.collect_list("fp").over(Window.partitionBy("v").orderBy("fp").rowsBetween(Window.unboundedPreceding, -1))
        found = variants.select(earlier.alias("before"), F.col("fp").alias("b")).select(F.explode("before").alias("a"), "b")
    return found.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that it can reach.

    Nodes without edges aren't listed. The number of rounds grows with the
    logarithm of the longest path.
    """
    now = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), name)
    mark = _mark(now)
    while mark[0]:
        # Large star: every node sends its larger neighbours to its least one (itself included).
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node sends its smaller neighbours and itself to the least of them.
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = materialize(low, name)
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), name)
        before, mark = mark, _mark(after)
        discard(now, low)
        now = after
        if mark == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._written_to = now._written_to
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def roots(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) of distinct fingerprints (column ``fp``, materialized): root is the least fingerprint of the component."""
    found = components(links(fingerprints, radius))
    return fingerprints.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def with_component(digests: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Adds component_id, the least doc_id of the component, to a table of ids and fingerprints (materialized: it is read twice)."""
    distinct = materialize(digests.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")), "fingerprints")
    known = distinct.join(roots(distinct, radius), "fp")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    label = known.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return digests.join(label, digests[fp] == label["__fp"]).drop("__fp")


def representatives(digests: DataFrame, order: list[str], key: str = "fp", known: DataFrame | None = None) -> DataFrame:
    """Of each component the row least in ``order`` (nulls last), with ``n``, the rows equal in these.

    ``digests`` is materialized. ``known`` has the root of every value of
    ``key``; without it they are fingerprints and RADIUS links them.
    """
    if known is None:
        known = roots(materialize(digests.select(F.col(key).alias("fp")).distinct(), "fingerprints")).withColumnRenamed("fp", key)
    rows = digests.groupBy(key, *order).agg(F.count(F.lit(1)).alias("n"))
    least = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], "n")
    return rows.join(known, key).groupBy("root").agg(F.min(least).alias("least")).select(*[F.col(f"least.{c}").alias(c) for c in order], "least.n")


def near_duplicates(documents: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null texts, empty texts and texts of white space have fingerprint zero and
    are one component with all that lie near zero. Repeated rows stay. A null
    doc_id is least of nothing: a component of null ids only has a null id. An
    empty table gives an empty result. Other columns aren't read.
    """
    digests = materialize(with_fingerprint(documents.select("doc_id", F.col(text).alias("text")), "text", ["doc_id"], "fp"), "simhash")
    done = with_component(digests, radius=radius)
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
