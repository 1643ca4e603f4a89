"""Near-duplicates of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

Equal sets are one node, named by a hash. Links are found in three steps; each
leaves less to the next, and the last leaves nothing out:

1. SimHash. Fingerprints of the sets meet by ball hashing (``simhash.links``),
   and nodes that share a fingerprint are chained. What meets is verified by the
   exact similarity. At radius 2 this finds the copies with the fewest changes.
2. Rounds of neighbours. Sets that share 4/5 of their union have a shingle in
   common among the first ``n // 5 + 1`` of each, in any order that holds for all
   sets (prefix filtering; Chaudhuri, Ganti and Kaushik 2006, Xiao et al. 2008).
   Rare shingles come first, so a passage that many texts share brings no two of
   them together unless it is most of both. In each round each member of a meeting
   (the nodes with one such shingle) is compared with two others, if they are in
   another component and their fingerprints aren't far apart: one by a seeded
   order, and one with the fewest shingles of its own. So a large group of near
   copies becomes one component by comparisons in proportion to its members.
3. The rest. All pairs of a meeting that are still in different components and
   can reach 0.8 are compared, in blocks of BLOCK by BLOCK members.

A pair can reach 0.8 only if, from the places that the shingle they meet on has
in both, enough shingles are left: the first one that they have in common
satisfies that. The counts behind the order are of 2^22 buckets; what they mix
up costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import discard, materialize, released, spread
from .simhash import components, majority, shingle_hashes

SHINGLE = 5
#: Members of a meeting that one block holds.
BLOCK = 256
#: Rounds of neighbours, and the most bits that fingerprints may differ in there; pairs of similarity 0.8 differ in 10 of 64 on average.
ROUNDS, FAR_BITS = 2, 20
#: Buckets of shingle counts: 1024 slices of 4096.
_BITS, _SLICES = 22, 1024
_PER_SLICE = (1 << _BITS) // _SLICES
_AT_ONCE = 1 << 20
#: Bits of the set of nodes that have a partner to be compared with, in slices likewise.
_NODE_BITS = 24


def with_shingles(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), the sorted set of the text's shingle hashes (``shingles``), a hash of that set (``node``) and its fingerprint (``fp``)."""
    from xxhash import xxh64_intdigest

    keep = list(df.columns) if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [np.unique(shingle_hashes(x or "", SHINGLE)) for x in b.column(b.num_columns - 1).to_pylist()]
                nodes, prints = (np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (lambda s: xxh64_intdigest(s.tobytes()), majority))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(nodes), pa.array(prints), lists], names=[*keep, "node", "fp", "shingles"])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(released(run), schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values as unsigned, and where each list ends, from 0."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def commonness(sets: DataFrame) -> np.ndarray:
    """For each of 2^22 buckets of shingles how common they are, as eight times the binary logarithm of their count."""

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate(held))
        cuts = np.searchsorted(buckets, np.arange(_SLICES + 1) * _PER_SLICE)
        low = (buckets % _PER_SLICE).astype("<u2")
        some = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())], names=["slice", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((_flat(b.column(0))[0] >> np.uint64(64 - _BITS)).astype(np.uint32))
            n += len(held[-1])
            if n >= _AT_ONCE:
                yield deal(held)
                held, n = [], 0
        if n:
            yield deal(held)

    def add(t: pa.Table) -> pa.Table:
        n = sum(np.bincount(np.frombuffer(x, "<u2"), minlength=_PER_SLICE) for x in t["held"].to_pylist())
        return pa.table({"slice": t["slice"][:1], "level": pa.array([np.minimum(np.round(8 * np.log2(n + 1)), 255).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros((_SLICES, _PER_SLICE), np.uint8)
    for r in sets.select("shingles").mapInArrow(released(run), "slice int, held binary").groupBy("slice").applyInArrow(add, "slice int, level binary").collect():
        out[r["slice"]] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out.ravel()


def first_shingles(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(v, node, pos): the n // 5 + 1 rarest shingles of each set of n and their places; once for equal sets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            values, ends = _flat(b.column(1))
            levels = common[(values >> np.uint64(64 - _BITS)).astype(np.int64)]
            picked, nodes = [], []
            for k, node in enumerate(b.column(0).to_pylist()):
                s, n = slice(ends[k], ends[k + 1]), int(ends[k + 1] - ends[k])
                if n and node not in seen:
                    seen.add(node)
                    # Values are sorted, so equal levels are in the order of the values in every set.
                    picked.append(values[s][np.argsort(levels[s], kind="stable")[: n // 5 + 1]])
                    nodes.append(node)
            if picked:
                times = [len(p) for p in picked]
                places = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), times)), pa.array(places)], names=["v", "node", "pos"])

    return sets.select("node", "shingles").mapInArrow(released(run), "v long, node long, pos int")


def _viable(a: str, b: str):
    """Whether a pair (fields n and pos) can have a similarity of 0.8 if the shingle that it meets on is its first in common."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    left = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (9 * left >= 4 * (na + nb))


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose node is one of ``ids``, and a few more: by a bitmap of 2 MB, so sets without partners aren't shuffled."""
    per = (1 << _NODE_BITS) // _SLICES

    def add(t: pa.Table) -> pa.Table:
        marks = np.zeros(per, np.uint8)
        marks[t["bit"].to_numpy() % per] = 1
        return pa.table({"slice": t["slice"][:1], "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    bits = ids.select(F.shiftrightunsigned("node", 64 - _NODE_BITS).alias("bit")).distinct().withColumn("slice", F.expr(f"CAST(bit DIV {per} AS INT)"))
    marks = np.zeros((_SLICES, per // 8), np.uint8)
    for r in bits.groupBy("slice").applyInArrow(add, "slice int, marks binary").collect():
        marks[r["slice"]] = np.frombuffer(bytes(r["marks"]), np.uint8)
    marks = marks.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - _NODE_BITS)).astype(np.int64)
            yield b.filter(pa.array((marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)))

    return sets.select("node", "shingles").mapInArrow(released(run), "node long, shingles array<long>")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more, written."""
    pairs = materialize(pairs, "jaccard-pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    own = materialize(_among(sets, ids).dropDuplicates(["node"]), "jaccard-sets")
    both = pairs.select("a", "b").join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    out = materialize(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "jaccard-links")
    discard(pairs, own)
    return out


def meetings(sets: DataFrame) -> DataFrame:
    """(v, node, pos, m) of each meeting of m > 1 distinct sets."""
    rows = first_shingles(sets, commonness(sets)).repartition("v").dropDuplicates(["v", "node"])
    met = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("v")))
    return materialize(met.where("m > 1"), "jaccard-meetings")


def alike_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that share a fingerprint, in a chain, or the least of those whose fingerprints lie within the radius."""
    held = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = simhash.links(held.select("fp"))
    across = near.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    chain = nodes.select(F.lag("node").over(Window.partitionBy("fp").orderBy("node")).alias("a"), F.col("node").alias("b")).where("a IS NOT NULL")
    return across.union(chain)


def _known(met: DataFrame, nodes: DataFrame) -> DataFrame:
    return met.join(nodes.select("node", "n", "fp", "root"), "node")


def neighbours(met: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) that can be alike and seem so, two at most for each member of a meeting and turn: with the one before it in a seeded order, and with one of those where the shingle comes earliest.

    The latter have the fewest shingles of their own, so of near copies they are
    those that most others are alike with. Members of one component aren't compared.
    """
    row = F.struct("node", "n", "pos", "fp", "root")
    seeded = Window.partitionBy("v").orderBy(F.xxhash64("node", "v", F.lit(turn)), "node")
    early = Window.partitionBy("v").orderBy("pos", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = _known(met, nodes).select(row.alias("x"), F.lag(row).over(seeded).alias("before"), F.nth_value(row, turn + 1).over(early).alias("early"))
    pairs = beside.select("x", F.explode(F.array("before", "early")).alias("y")).where("x.root <> y.root")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= FAR_BITS
    pairs = pairs.where(_viable("x.", "y.") & near)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def across(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pair (a, b) of members of a meeting in different components that can have a similarity of 0.8."""
    by = Window.partitionBy("v")
    split = _known(met, nodes).select("v", "node", "n", "pos", "root", "m", F.min("root").over(by).alias("lo"), F.max("root").over(by).alias("hi"), F.row_number().over(by.orderBy("node")).alias("k")).where("lo <> hi")
    dealt = split.select("v", F.struct("node", "n", "pos", "root").alias("x"), F.floor((F.col("k") - 1) / BLOCK).cast("int").alias("block"), F.floor((F.col("m") - 1) / BLOCK).cast("int").alias("last"))
    # A row goes to every pair of blocks that its own is in: as earlier or as later one.
    early = dealt.select("v", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), "x")
    late = dealt.select("v", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("x").alias("y"))
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _viable("x.", "y.")
    return early.join(late, ["v", "i", "j"]).where(apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes with the roots of their components after these links (a, b) between nodes. Both tables are discarded."""
    if links.isEmpty():
        discard(links)
        return nodes
    a, b = nodes.select(F.col("node").alias("a"), F.col("root").alias("x")), nodes.select(F.col("node").alias("b"), F.col("root").alias("y"))
    edges = links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    new = components(edges, "jaccard-roots")
    out = materialize(nodes.join(new.toDF("root", "to"), "root", "left").select("node", "n", "fp", F.coalesce("to", "root").alias("root")), "jaccard-nodes")
    discard(nodes, links, new)
    return out


def roots(sets: DataFrame) -> DataFrame:
    """(node, root) of every node: the least node that links of a similarity of 0.8 or more reach. ``sets`` (node, fp, shingles) is materialized; nodes may repeat."""
    nodes = sets.select("node", F.size("shingles").alias("n"), "fp").dropDuplicates(["node"]).withColumn("root", F.col("node"))
    nodes = materialize(nodes, "jaccard-nodes")
    nodes = _joined(nodes, verified(sets, alike_prints(nodes)))
    met = meetings(sets)
    for turn in range(ROUNDS):
        nodes = _joined(nodes, verified(sets, neighbours(met, nodes, turn)))
    nodes = _joined(nodes, verified(sets, across(met, nodes)))
    discard(met)
    return nodes.select("node", "root")
