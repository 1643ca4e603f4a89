"""Sharding by a k-d tree over metadata.

A node is split along its widest dimension at the weighted median, weights
being bytes, until every leaf is one shard of the target bytes. All nodes of a
level are split together. The median is found by distributed histograms: each
pass sums the bytes of BINS bins of every node's rank key, the driver picks the
bin that holds the median, and the next pass looks into that bin only. So the
driver sees at most BINS sums for each node and pass, whatever the number of
rows; once at most FEW rows are left in the bin, their keys are fetched instead.

The rank key of a row in a node is (place along the widest dimension, text
digest, id digest). Rows tied along the dimension are ordered by their text, so
equal texts lie together if dimensions are functions of the text, and cuts go
between texts. Only a group of copies with more than MOST_WHOLE of a shard's
bytes is cut, by its ids.

Each cut is off by half a text at most, and these errors add up from level to level.
At the end some whole groups of copies change their shards until sizes agree: a
few candidates of each shard, one of each size class, reach the driver, and no more
than MOST_MOVES groups a shard are moved. Where texts are small beside a shard,
next to none are. Only groups of copies that a cut went through stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, discard, gapless, materialize

DIGIT = 11
BINS = 1 << DIGIT
TOLERANCE = 0.002
#: The share of a shard's target that a group of equal texts may hold and still stay whole.
MOST_WHOLE = 0.5
FEW = 4000
#: Digits of the parts of a rank key: place, text digest, id digest.
PLACE_DIGITS, TEXT_DIGITS, ID_DIGITS = 2, 3, 4
#: Groups that a shard gives or takes at the end at most, and size classes of candidates from one size to its double.
MOST_MOVES, CLASSES = 8, 16
#: Rows of a shard that are numbered in one group.
PER_GROUP = 4000


def text_dimensions(text: Column) -> dict[str, Column]:
    """What shape a text has: the logarithm of its characters, and its bytes a character (its script)."""
    chars = F.coalesce(F.length(text), F.lit(0)).cast("double")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("double")
    return {"dim_chars": F.log1p(chars), "dim_script": F.when(chars > 0, size / chars).otherwise(F.lit(1.0))}


@dataclass
class _Cut:
    """One node's split: rows whose leading digits are below ``bounds`` go left."""

    dim: str
    low: float
    high: float
    total: int
    want: float
    whole: float  # bytes of a group of equal texts that isn't cut
    below: int = 0
    rows: int = 0  # in the open bin
    bounds: list[int] = field(default_factory=list)
    done: bool = False

    def digits(self, text_digest: str, id_digest: str) -> list[Column]:
        top = (1 << DIGIT * PLACE_DIGITS) - 1
        place = F.floor((F.col(self.dim) - self.low) / (self.high - self.low) * top).cast("long") if self.high > self.low else F.lit(0).cast("long")
        parts = ((place, PLACE_DIGITS), (F.col(text_digest), TEXT_DIGITS), (F.col(id_digest), ID_DIGITS))
        return [F.shiftrightunsigned(part, DIGIT * k).bitwiseAND(BINS - 1) for part, n in parts for k in range(n - 1, -1, -1)]

    def narrow(self, sums: list[tuple[int, int, int]], step: int, tolerance: float) -> None:
        """Put the cut at an edge of the bins (bin, bytes, rows), or go into the bin that holds it."""
        last, text = step == PLACE_DIGITS + TEXT_DIGITS + ID_DIGITS - 1, step == PLACE_DIGITS + TEXT_DIGITS - 1
        for b, w, n in sums:
            if self.below + w <= self.want:
                self.below += w
                continue
            under, over = self.want - self.below, self.below + w - self.want
            if last or (text and w <= self.whole) or min(under, over) <= tolerance * self.total:
                self.bounds.append(b if under <= over else b + 1)
                self.done = True
            else:
                self.bounds.append(b)
                self.rows = n
            return
        self.bounds.append(sums[-1][0] + 1 if sums else 0)
        self.done = True

    def finish(self, keys: list[tuple[list[int], int]], tolerance: float) -> None:
        """The same, from the keys and bytes of all rows of the open bin."""
        for step in range(len(self.bounds), PLACE_DIGITS + TEXT_DIGITS + ID_DIGITS):
            if self.done:
                return
            sums: dict[int, list[int]] = {}
            for digits, w in keys:
                if digits[:step] == self.bounds:
                    held = sums.setdefault(digits[step], [0, 0])
                    held[0] += w
                    held[1] += 1
            self.narrow(sorted((b, w, n) for b, (w, n) in sums.items()), step, tolerance)

    def left(self, digits: list[Column]) -> Column:
        is_left = F.lit(False)
        for d, b in reversed(list(zip(digits, self.bounds))):
            is_left = (d < b) | ((d == b) & is_left)
        return is_left

    def inside(self, digits: list[Column]) -> Column:
        out = F.lit(True)
        for d, b in zip(digits, self.bounds):
            out = out & (d == b)
        return out


def kd_shards(rows: DataFrame, dims: list[str], weight: str, text_digest: str, id_digest: str, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``shard``, from 0 to n_shards - 1, of about equal weight.

    ``rows`` should be materialized: it is read several times a level. Dimensions
    are doubles without nulls, weights positive integers, digests longs. n_shards
    need not be a power of two: a node of s shards is split at floor(s / 2) / s.
    A range is compared with the range over all rows. Rows equal in all parts of
    the key stay together. Without rows the result is empty.
    """
    now = rows.withColumn("__node", F.lit(0))
    nodes = {0: (0, n_shards)}  # first shard, number of shards
    ranges: dict[str, float] = {}
    n_digits = PLACE_DIGITS + TEXT_DIGITS + ID_DIGITS
    while any(many > 1 for _, many in nodes.values()):
        spans = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["__node"]: r for r in now.groupBy("__node").agg(F.sum(weight).alias("__total"), F.count(F.lit(1)).alias("__rows"), *spans).collect()}
        if not stats:
            break
        ranges = ranges or {d: (stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) or 1.0 for d in dims}
        cuts: dict[int, _Cut] = {}
        for n, (_, many) in nodes.items():
            if many > 1 and n in stats:
                r = stats[n]
                dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / ranges[d])
                cuts[n] = _Cut(dim, r[f"lo_{dim}"], r[f"hi_{dim}"], r["__total"], r["__total"] * (many // 2) / many, MOST_WHOLE * r["__total"] / many, rows=r["__rows"])
        digits = {n: c.digits(text_digest, id_digest) for n, c in cuts.items()}
        for step in range(n_digits):
            few = {n: c for n, c in cuts.items() if not c.done and c.rows <= FEW}
            if few:
                keys: dict[int, list] = {n: [] for n in few}
                held = F.lit(None).cast("array<bigint>")
                for n, c in few.items():
                    held = F.when((F.col("__node") == n) & c.inside(digits[n]), F.array(*digits[n])).otherwise(held)
                for r in now.select("__node", weight, held.alias("__key")).where("__key is not null").collect():
                    keys[r["__node"]].append((list(r["__key"]), r[weight]))
                for n, c in few.items():
                    c.finish(keys[n], tolerance)
            searched = {n: c for n, c in cuts.items() if not c.done}
            if not searched:
                break
            bins = F.lit(None).cast("long")
            for n, c in searched.items():
                bins = F.when((F.col("__node") == n) & c.inside(digits[n]), digits[n][step]).otherwise(bins)
            sums: dict[int, list[tuple[int, int, int]]] = {n: [] for n in searched}
            for r in now.select("__node", weight, bins.alias("__bin")).where("__bin is not null").groupBy("__node", "__bin").agg(F.sum(weight).alias("__w"), F.count(F.lit(1)).alias("__n")).collect():
                sums[r["__node"]].append((r["__bin"], r["__w"], r["__n"]))
            for n, c in searched.items():
                c.narrow(sorted(sums[n]), step, tolerance)
        child, following = F.lit(None).cast("int"), {}
        for n, (at, many) in nodes.items():
            if n in cuts:
                half = many // 2
                following[2 * n + 1], following[2 * n + 2] = (at, half), (at + half, many - half)
                child = F.when(F.col("__node") == n, F.when(cuts[n].left(digits[n]), 2 * n + 1).otherwise(2 * n + 2)).otherwise(child)
            elif many == 1:
                following[2 * n + 1] = (at, 1)
                child = F.when(F.col("__node") == n, 2 * n + 1).otherwise(child)
        before, now = now, materialize(now.withColumn("__child", child).drop("__node").withColumnRenamed("__child", "__node"), "kd")
        discard(before)
        nodes = following
    shard = F.lit(0)
    for n, (at, _) in nodes.items():
        shard = F.when(F.col("__node") == n, at).otherwise(shard)
    return now.withColumn("shard", shard.cast("int")).drop("__node")


def _moves(totals: dict[int, int], held: dict[int, list[tuple[int, int]]], tolerance: float) -> dict[int, int]:
    """{group: shard} that brings totals nearer to their mean. ``held``: candidates (group, weight) of each shard.

    The shard that is farthest off and another exchange a group, or a group for a
    lighter one, such that the larger of their two errors shrinks most; if it can't,
    the next one does.
    """
    mean = sum(totals.values()) / len(totals)
    error, held, out = {s: w - mean for s, w in totals.items()}, {s: dict(held.get(s, ())) for s in totals}, {}

    def best(i: int) -> tuple | None:
        found = None
        for j in totals:
            mine, theirs = ([(None, 0), *sorted(held[s].items(), key=lambda c: (c[1], c[0]))] for s in (i, j))
            gap = np.array([w for _, w in mine])[:, None] - np.array([w for _, w in theirs])[None]
            after = np.maximum(np.abs(error[i] - gap), np.abs(error[j] + gap))
            at = np.unravel_index(np.argmin(after), after.shape)
            if j != i and after[at] < max(abs(error[i]), abs(error[j])) - 0.5 and (found is None or after[at] < found[0]):
                found = float(after[at]), j, mine[at[0]], theirs[at[1]]
        return found

    for _ in range(MOST_MOVES * len(totals)):
        if max(map(abs, error.values())) <= tolerance * mean:
            break
        i, found = next(((i, f) for i in sorted(totals, key=lambda s: (-abs(error[s]), s)) if (f := best(i)) is not None), (None, None))
        if found is None:
            break
        _, j, *pair = found
        for (group, w), of, to in ((pair[0], i, j), (pair[1], j, i)):
            if group is not None:
                del held[of][group]
                out[group] = to
                error[of] -= w
                error[to] += w
    return out


def exchanged(put: DataFrame, weight: str, text_digest: str, n_shards: int, tolerance: float) -> DataFrame:
    """``put`` with ``shard`` changed for some whole groups of equal text digests, so that weights agree within the tolerance where single texts allow it."""
    groups = materialize(put.groupBy("shard", text_digest).agg(F.sum(weight).alias("__w")), "shard-groups")
    totals = {s: 0 for s in range(n_shards)} | {r["shard"]: r["w"] for r in groups.groupBy("shard").agg(F.sum("__w").alias("w")).collect()}
    # One group of each size class: some hundreds a shard. Those that a cut went through stay where they are.
    whole = groups.groupBy(text_digest).agg(F.count(F.lit(1)).alias("__n"), F.max("__w").alias("__w"), F.max("shard").alias("shard")).where("__n = 1")
    some = whole.groupBy("shard", F.floor(F.log2("__w") * CLASSES).alias("class")).agg(F.min(F.struct(text_digest, "__w")).alias("c")).select("shard", f"c.{text_digest}", "c.__w").collect()
    held: dict[int, list[tuple[int, int]]] = {}
    for shard, group, w in sorted(some):
        held.setdefault(shard, []).append((group, w))
    moves = _moves(totals, held, tolerance)
    discard(groups)
    if not moves:
        return put
    # Broadcast: at most 2 * MOST_MOVES rows a shard.
    to = put.sparkSession.createDataFrame(sorted(moves.items()), "__group long, __to int")
    return put.join(F.broadcast(to), F.col(text_digest) == F.col("__group"), "left").withColumn("shard", F.coalesce("__to", "shard")).drop("__group", "__to")


def shard_documents(documents: DataFrame, n_shards: int = 16, text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Law ``bytes``: shards of nearly equal size, a document's size being its
    UTF-8 bytes and 1. Null texts have the bytes and checksum of empty ones.
    Copies of a text share a shard unless they hold more than MOST_WHOLE of its
    bytes. Rows with null or repeated doc_id are placed like others. Slots follow
    doc_id within dealt groups. An empty table gives none. Other columns, of any
    name, aren't read.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    digest = documents.select(
        "doc_id", (F.octet_length(held) + 1).cast("long").alias("size"), F.crc32(held).alias("text_crc32"),
        F.xxhash64(held).alias("text_hash"), F.xxhash64("doc_id").alias("id_hash"), dealt("doc_id", F.crc32(held)).alias("deal"), *[c.alias(n) for n, c in text_dimensions(held).items()],
    )
    digest = materialize(digest, "shards")
    put = kd_shards(digest, ["dim_chars", "dim_script"], "size", "text_hash", "id_hash", n_shards, tolerance)
    put = exchanged(put, "size", "text_hash", n_shards, max(tolerance, TOLERANCE))
    rows = digest.count()
    n_groups = F.lit(max(1, -(-rows // (n_shards * PER_GROUP))))
    put = gapless(put.select("doc_id", "size", "text_crc32", "shard", "deal"), "shard", ["doc_id", "text_crc32", "deal"], ["deal"], "slot", n_groups)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
