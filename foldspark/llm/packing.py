"""Best-fit packing with Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the whole instance is a histogram
of at most ``capacity`` counts, however many documents there are. The driver
solves it in run-length form: a solution is a list of (pattern, multiplicity).

1. Reduction. For the longest piece, if a set of at most three pieces with it
   provably dominates every other set that holds it, that set is fixed for
   good, as often as counts allow, and the instance shrinks (Martello and Toth,
   Knapsack Problems, 1990, ch. 8).
2. Best-fit decreasing packs what is left.

Documents then take places: pieces of a length are numbered without gaps, and
the number's place in the intervals of that length gives the sequence and the
offset. Nothing but the histogram reaches the driver, and the places
broadcast are bounded by the number of patterns.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, gapless, materialize, released, spread
from .tokens import encoder, pieces

CAPACITY = 1024
#: The id after each document's own.
STOP_ID = 2
#: Rows of one length that are numbered in one group.
PER_GROUP = 4000

Pattern = tuple[tuple[int, ...], int]


class _Lengths:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.left = sorted(self.n)

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if not self.n[length]:
            del self.n[length]
            self.left.pop(bisect_left(self.left, length))

    def others(self, but: int) -> list[int]:
        """Lengths of pieces other than one of length ``but``, ascending."""
        if self.n.get(but, 0) != 1:
            return self.left
        k = bisect_left(self.left, but)
        return self.left[:k] + self.left[k + 1 :]

    def two(self, lengths: list[int], k: int, but: int) -> int:
        """Sum of the two shortest pieces from place k of ``lengths`` on, of others(but)."""
        if k >= len(lengths):
            return 1 << 60
        if self.n[lengths[k]] - (lengths[k] == but) > 1:
            return 2 * lengths[k]
        return lengths[k] + lengths[k + 1] if k + 1 < len(lengths) else 1 << 60


def _dominating(left: _Lengths, first: int, capacity: int) -> tuple[int, ...] | None:
    """What to put with ``first`` so that no other set with it is better; None if unknown."""
    room = capacity - first
    free = left.others(first)
    k = bisect_right(free, room) - 1
    if k < 0:
        return ()
    largest = free[k]
    if largest == room or left.two(free, 0, first) > room:
        return (largest,)  # fills it, or only one more fits and this is the longest
    shortest = free[0]
    three = left.two(free, 0, first) + (free[0] if left.n[shortest] - (shortest == first) > 2 else free[1] if len(free) > 1 else 1 << 60)
    if three <= room:
        return None
    best = 0  # longest sum of two that fit
    lo, hi = 0, k
    while lo <= hi:
        if lo == hi and left.n[free[lo]] - (free[lo] == first) < 2:
            break
        total = free[lo] + free[hi]
        if total > room:
            hi -= 1
        else:
            best = max(best, total)
            lo += 1
    if largest >= best:
        return (largest,)
    # With the longest that fits: any other two are no longer, one by one, if no two longer than the third fit.
    m = bisect_right(free, room - largest) - 1
    if m >= 0 and (free[m] != largest or left.n[largest] - (largest == first) > 1) and left.two(free, m + 1, first) > room:
        return (largest, free[m])
    return None


def _times(left: _Lengths, pattern: tuple[int, ...]) -> int:
    return min(left.n[x] // pattern.count(x) for x in set(pattern))


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed sets and the counts that are left.

    Lengths are taken from the longest; one that nothing is known to dominate is
    skipped. A fixed set is repeated as long as its lengths last: the criterion
    compares lengths only, and those that are left stay the same until then.
    """
    left = _Lengths(counts)
    fixed: list[Pattern] = []
    skipped: set[int] = set()
    changed = True
    while changed:
        changed = False
        skipped.clear()
        at = len(left.left) - 1
        while at >= 0:
            first = left.left[at]
            more = _dominating(left, first, capacity)
            if more is None:
                at -= 1
                continue
            pattern = (first, *more)
            if _times(left, pattern) < 1:
                at -= 1
                continue
            times = _times(left, pattern)
            if times > 1 and len(set(pattern)) < len(pattern):
                times = max(1, times - 1)  # the last may meet a single piece of its own length
            for x in pattern:
                left.take(x, times)
            fixed.append((pattern, times))
            changed = True
            at = min(at, len(left.left) - 1)
            while at + 1 < len(left.left) and left.left[at] < first:
                at += 1
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing of whole runs of equal lengths.

    Bins with the same pattern are one entry with a multiplicity. A piece goes
    to the fullest bin that has room; after it, that bin is still the fullest
    for the next of the run, so each bin takes as many as fit.
    """
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(k)
            else:
                room, pattern = capacity, ()
                times = -(-todo // (capacity // length))
            each = room // length
            full = min(times, todo // each)
            part = todo - full * each if full < times else 0
            part = min(part, each)
            put(room - each * length, pattern + (length,) * each, full)
            if part:
                put(room - part * length, pattern + (length,) * part, 1)
            put(room, pattern, times - full - bool(part) if pattern else 0)
            todo -= full * each + part
    return [x for room in rooms for x in bins[room]]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths and how often each is used, over all pieces counted."""
    if any(k < 1 or k > capacity for k, v in counts.items() if v):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Sequence and offset of the r-th piece of each length, from a packing."""

    def __init__(self, patterns: list[Pattern]):
        used: dict[int, int] = {}
        rows: list[tuple[int, int, int, int]] = []
        base = 0
        for pattern, times in patterns:
            offset = 0
            for x in pattern:
                rows.append((x, used.get(x, 0), base, offset))
                used[x] = used.get(x, 0) + times
                offset += x
            base += times
        rows.sort()
        self.n_sequences = base
        a = np.array(rows, np.int64).reshape(-1, 4)
        self.keys, self.starts, self.bases, self.offsets = (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 44) + rank, side="right") - 1
        return self.bases[at] + rank - self.starts[at], self.offsets[at]


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def token_pieces(documents: DataFrame, text: str = "text", capacity: int = CAPACITY, stop: int = STOP_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, for writers).

    A document's ids end with ``stop``. Only documents longer than the capacity
    are cut; their first piece takes the remainder, so all others are full.
    """
    schema = T.StructType([*PIECE.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        tail = np.array([stop], "<u4")
        for b in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate([*(enc.ids(x) for x in pieces(value or "")), tail]).astype("<u4", copy=False)
                raw, n = ids.tobytes(), len(ids)
                at, k, end = 0, 0, n if n <= capacity else n % capacity or capacity
                while at < n:
                    part = raw[4 * at : 4 * end]
                    rows.append((doc_id, k, at, end - at, zlib.crc32(part), part))
                    at, end, k = end, min(n, end + capacity), k + 1
                if len(rows) >= 50_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(schema.fields)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(released(cut), schema)


def place(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, length and ``deal`` (materialized: it is read twice).

    ``deal`` puts the pieces of a length into groups and isn't kept.
    """
    spark = pieces_.sparkSession
    counts = {r["length"]: r["count"] for r in pieces_.groupBy("length").count().collect()}
    kept = [c for c in pieces_.columns if c != "deal"]
    schema = T.StructType([*(pieces_.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not counts:
        return spark.createDataFrame([], schema)
    places = spark.sparkContext.broadcast(Places(pack(counts, capacity)))
    n_buckets = F.element_at(F.lit([-(-counts.get(k, 0) // PER_GROUP) or 1 for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    numbered = gapless(pieces_, "length", ["doc_id", "piece", "deal"], ["deal"], "__number", n_buckets)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__number"))
            sequence, offset = places.value.of(length, number)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return numbered.select(*kept, "__number").mapInArrow(released(take), schema)


def pack_documents(documents: DataFrame, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Null and empty texts are one piece of the closing id. Repeated rows are
    packed each; ties in length take places by doc_id and piece. An empty table
    gives no pieces. Other columns aren't read.
    """
    found = token_pieces(documents, text, capacity).withColumn("deal", dealt("doc_id", F.col("piece"), F.col("ids_crc32")))
    return place(materialize(found, "pieces"), capacity)
