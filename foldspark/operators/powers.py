"""Powers of a sparse matrix that is an edge table: blocks of rows meet blocks of columns.

A product as a join makes a row for each path and shuffles all of them to sum them by
their ends, and that is some thousands a node for a third power. Here nodes are dealt
into blocks by a hash of the id and edges, once, into tiles between blocks. A task has
one block of rows of the power so far; the matrix streams past it, one block of columns
after the other, and each meeting gives entries of the next power that are
whole: paths are summed where they are found, and no table of them is shuffled. Powers in
between stay tiles; the last isn't written, its entries are given out as they are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import discard, materialize, owning

#: Entries that a block of rows may have before the last product, about: 16 bytes each.
MOST_HELD = 1 << 22
#: Rows of a block, unless all are fewer: at least.
LEAST_ROWS = 256
#: Paths that are summed at once.
MOST_PATHS = 1 << 18

TILE = "to int, frm int, r binary, c binary, w binary"


def _read(raw: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def _nodes(column: int, places: np.ndarray) -> np.ndarray:
    """One number for each node, by its block and its place there."""
    return np.int64(column) << 32 | places.astype(np.int64)


def gathered(tiles: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(r, at, w, need) of a block of rows, by row: ``need`` are the nodes that its entries go to, ``at`` the place of each entry's there."""
    if not tiles:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    r = np.concatenate([t[1] for t in tiles])
    order = np.argsort(r, kind="stable")
    need, at = np.unique(np.concatenate([_nodes(t[0], t[2]) for t in tiles])[order], return_inverse=True)
    return r[order], at, np.concatenate([t[3] for t in tiles])[order], need


def multiplied(block: tuple[np.ndarray, ...], tiles: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], most: int = MOST_PATHS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(r, c, w): the entries of a block of rows times a block of columns, in order; at most ``most`` paths, one entry's and a row's sums are held at once."""
    r, at, w, need = block
    if not len(need) or not tiles:
        return
    m = np.concatenate([_nodes(t[0], t[1]) for t in tiles])
    place = np.minimum(np.searchsorted(need, m), len(need) - 1)
    met = np.flatnonzero(need[place] == m)
    place = place[met]
    c, v = np.concatenate([t[2] for t in tiles])[met], np.concatenate([t[3] for t in tiles])[met]
    # Tiles come by their rows' blocks and are in order, so equal rows lie together.
    count = np.bincount(place, minlength=len(need))
    first = np.cumsum(count) - count
    paths = count[at]
    used = np.flatnonzero(paths)
    ends = np.cumsum(paths[used])
    bits = int(c.max(initial=0)).bit_length()
    s, rest = 0, None
    while s < len(used):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        mine = used[s:e]
        n, low = paths[mine], int(r[mine[0]])
        kind = np.int32 if (int(r[mine[-1]]) - low + 1) << bits < 1 << 31 else np.int64
        g = np.repeat(first[at[mine]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat((r[mine] - low).astype(kind) << kind(bits), n) | c[g]
        x = np.repeat(w[mine], n) * v[g]
        if rest is not None:  # sums of a row that was cut; it is the first one here
            key, x = np.concatenate([rest[0].astype(kind), key]), np.concatenate([rest[1], x])
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        key, x = key[start], np.add.reduceat(x[order], start)
        rest = None
        if e < len(used) and r[used[e]] == r[mine[-1]]:
            cut = int(np.searchsorted(key, kind(int(r[mine[-1]]) - low) << kind(bits)))
            rest = key[cut:] & kind((1 << bits) - 1), x[cut:]
            key, x = key[:cut], x[:cut]
        if len(key):
            yield (key >> kind(bits)).astype(np.int32) + np.int32(low), (key & kind((1 << bits) - 1)).astype(np.int32), x
        s = e


def _tile(e: pd.DataFrame) -> pd.DataFrame:
    e = e.sort_values(["r", "c"])
    return pd.DataFrame({"to": e["to"].iloc[:1], "frm": e["frm"].iloc[:1], "r": [e["r"].to_numpy(np.int32).tobytes()], "c": [e["c"].to_numpy(np.int32).tobytes()], "w": [e["w"].to_numpy(float).tobytes()]})


def n_blocks(n: int, held: float, cores: int) -> int:
    """Blocks of rows for n nodes of which the powers before the last have so many entries: two a core, more if a block held too many, none without its rows."""
    return max(1, min(n // LEAST_ROWS, max(2 * cores, -(-int(held) // MOST_HELD))))


def _product(left: DataFrame, right: DataFrame, rows: DataFrame, parts: int, last: bool) -> DataFrame:
    """The product of two tables of tiles: tiles, or with ``last`` (i, j, w)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = block = ids = others = None
        at, mine, theirs = -1, [], []

        def met() -> Iterator[pa.RecordBatch]:
            for r, c, w in multiplied(block, theirs):
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(others[c]), pa.array(w)], names=["i", "j", "w"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([at], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (r, c, w)]], names=["to", "frm", "r", "c", "w"])

        for b in batches:
            for own, column, kind, frm, r, c, w in zip(*[b.column(k).to_pylist() for k in range(4)], b.column(4), b.column(5), b.column(6)):
                if column != at:
                    if at < 0:
                        block, mine = gathered(mine), []
                    else:
                        yield from met()
                    to, at, theirs = own, column, []
                if kind == 0:
                    ids, others = (_read(w, np.int64).copy(), others) if column < 0 else (ids, _read(w, np.int64).copy())
                else:
                    (mine if column < 0 else theirs).append((frm, _read(r, np.int32).copy(), _read(c, np.int32).copy(), _read(w, np.float64).copy()))
        if at >= 0:
            yield from met()

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("to")
    # What a task gets, in this order: its own rows (at -1), then for each block of columns that block's ids and tiles.
    dealt = left.select("to", F.lit(-1).alias("at"), F.lit(1).alias("kind"), "frm", "r", "c", "w")
    dealt = dealt.union(right.select(every, F.col("frm").alias("at"), F.lit(1), F.col("to").alias("b"), "r", "c", "w"))
    if last:
        none = F.lit(None).cast("binary")
        dealt = dealt.union(rows.select(F.col("b").alias("to"), F.lit(-1), F.lit(0), F.lit(-1), none, none, "ids"))
        dealt = dealt.union(rows.select(every, F.col("b").alias("at"), F.lit(0), F.lit(-1), none, none, "ids"))
    met = dealt.repartitionById(parts, "to").sortWithinPartitions("to", "at", "kind", "frm")
    return met.mapInArrow(add, "i long, j long, w double" if last else TILE)


def power(edges: DataFrame, t: int) -> DataFrame:
    """(i, j, w): edges ** t, t at least 2. Only what it reads is written, and it owns that."""
    held = edges if hasattr(edges, "_written_to") else materialize(edges.select("i", "j", "w"), "power-edges")
    out, into = held.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("a")), held.groupBy(F.col("j").alias("id")).agg(F.count(F.lit(1)).alias("b"))
    nodes = materialize(out.join(into, "id", "full").select("id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "power-nodes")
    n, e, twice = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()
    # Paths of t - 1 edges, if they branch on as those of two do; there are no more entries.
    branches = min(max(twice / max(e, 1), 1.0), float(max(n, 1)))
    before = min(float(n) * n, e * branches ** min(t - 2, 64))
    parts = n_blocks(n, before, edges.sparkSession.sparkContext.defaultParallelism)
    pack = F.udf(lambda ids: np.array(ids, np.int64).tobytes(), "binary")
    b = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("b")
    dealt = materialize(nodes.groupBy(b).agg(F.array_sort(F.collect_list("id")).alias("ids")), "power-blocks")
    places = dealt.select("b", F.posexplode("ids").alias("k", "id"))
    placed = held.select("i", "j", "w").join(places.toDF("to", "r", "i"), "i").join(places.toDF("frm", "c", "j"), "j").select("to", "frm", "r", "c", "w")
    tiles = materialize(placed.groupBy("to", "frm").applyInPandas(_tile, TILE), "power-tiles")
    rows = materialize(dealt.select("b", pack("ids").alias("ids")), "power-rows")
    discard(nodes, dealt)
    if held is not edges:
        discard(held)
    now = tiles
    for _ in range(t - 2):
        last, now = now, materialize(_product(now, tiles, rows, parts, False), "power")
        if last is not tiles:
            discard(last)
    return owning(_product(now, tiles, rows, parts, True), now, tiles, rows)
