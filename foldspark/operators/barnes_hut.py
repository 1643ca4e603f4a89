"""Barnes-Hut repulsion over tables.

A cell of a quadtree is a prefix of Morton codes, so the tree is a table
(level, code, n, x, y) with each cell's count and centre of mass. It is rolled up
from points in the order of their codes: a task sums runs of one code at every
level, and equal cells of neighbouring tasks, few, are added.

Points in that order form blocks, each a row with its bounding box. From the root
down, a table of (block, cell) pairs holds the cells that some point of the block
may have to look at: a pair is opened into the cells below if the box is too near
for the cell to stand for its points. What a block gathers is all that its points
need, some cells a level, not the tree; then each block walks its own cells, point
by point as the tree in one task does, and gives the same sums.

Work and rows grow with points times levels. A theta of 0 opens every cell for
every block, so it is all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout_tsne import DEPTH, walk
from ..materialize import discard, materialize

#: Points of a block.
BLOCK_ROWS = 256
#: Levels of at most so many cells are broadcast, 24 bytes each; larger ones are shuffled.
MOST_CELLS = 500_000
#: Parts that the cells of one code are dealt into where a level is shuffled.
SALT = 16
#: Levels that are opened between two writes.
LEVELS_AT_ONCE = 4
#: Boxes count as nearer by this share, so that rounding never hides a cell from a point.
SLACK = 1e-9


def _spread_bits(v: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def coded(positions: DataFrame, low: tuple[float, float], side: float, depth: int = DEPTH) -> DataFrame:
    """Adds the Morton code of each (x, y) in a grid of 2 ** depth cells a side over the square at ``low``."""
    def cell(c: str, at: float) -> Column:
        return F.least(F.greatest(F.floor((F.col(c) - at) / side * float(1 << depth)), F.lit(0)), F.lit((1 << depth) - 1)).cast("long")

    return positions.withColumn("code", _spread_bits(cell("x", low[0])).bitwiseOR(F.shiftleft(_spread_bits(cell("y", low[1])), 1)))


def _square(positions: DataFrame) -> tuple[tuple[float, float], float]:
    b = positions.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if b[0] is None:
        return (0.0, 0.0), 1.0
    return (b[0], b[1]), max(b[2] - b[0], b[3] - b[1]) * (1 + 1e-9) or 1.0


def blocks_of(positions: DataFrame, low: tuple[float, float], side: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, x0, x1, y0, y1, lo, hi, ids, codes, at): runs of points in the order of their codes, as rows. Written.

    A block is named by its first id. Points at one place are dealt apart by their ids.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y, code, ids = (b[c].to_numpy() for c in ("x", "y", "code", "id"))
            out = []
            for s in range(0, len(b), rows):
                e = min(s + rows, len(b))
                out.append((ids[s], x[s:e].min(), x[s:e].max(), y[s:e].min(), y[s:e].max(), code[s], code[e - 1], ids[s:e].tobytes(), code[s:e].tobytes(), np.stack([x[s:e], y[s:e]], 1).tobytes()))
            yield pd.DataFrame(out, columns=["block", "x0", "x1", "y0", "y1", "lo", "hi", "ids", "codes", "at"])

    # Straight from the sort: a block is a gapless run of the order.
    ordered = coded(positions.select("id", "x", "y"), low, side).repartitionByRange("code", "id").sortWithinPartitions("code", "id")
    return materialize(ordered.mapInPandas(cut, "block long, x0 double, x1 double, y0 double, y1 double, lo long, hi long, ids binary, codes binary, at binary"), "tree-blocks")


def cells_of(blocks: DataFrame) -> DataFrame:
    """(level, code, n, cx, cy): every cell with points, down to where it holds one, with its centre of mass. Written."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for codes, at in zip(b["codes"], b["at"]):
                code, at = np.frombuffer(codes, np.int64), np.frombuffer(at).reshape(-1, 2)
                alone = np.zeros(len(code), bool)  # points that a cell further up held alone
                for level in range(DEPTH + 1):
                    of = code >> 2 * (DEPTH - level)
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    n = np.diff(np.append(first, len(of)))
                    wanted = ~alone[first]
                    # A run at either end may go on in another block, so it isn't known to be alone.
                    alone[first[(n == 1) & (first > 0) & (first + n < len(of))]] = True
                    sums = np.add.reduceat(at, first, axis=0)[wanted]
                    out.append(pd.DataFrame({"level": np.full(len(sums), level, np.int32), "code": of[first][wanted], "n": n[wanted], "sx": sums[:, 0], "sy": sums[:, 1]}))
            if out:
                yield pd.concat(out)

    each = blocks.select("codes", "at").mapInPandas(runs, "level int, code long, n long, sx double, sy double")
    return materialize(each.groupBy("level", "code").agg(F.sum("n").alias("n"), (F.sum("sx") / F.sum("n")).alias("cx"), (F.sum("sy") / F.sum("n")).alias("cy")), "tree-cells")


def _may_open(theta: float, side: float) -> Column:
    """Whether some point of the block may have to look below a cell."""
    c = {k: F.col(k) for k in ("x0", "x1", "y0", "y1", "cx", "cy")}
    dx = F.greatest(c["x0"] - c["cx"], c["cx"] - c["x1"], F.lit(0.0))
    dy = F.greatest(c["y0"] - c["cy"], c["cy"] - c["y1"], F.lit(0.0))
    width = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    above = F.lit(4.0) ** (DEPTH - F.col("level"))
    own = (F.col("lo") < (F.col("code") + 1) * above) & (F.col("hi") >= F.col("code") * above)
    near = width * width * (1 + SLACK) >= theta * theta * (dx * dx + dy * dy)
    return (F.col("n") > 1) & (F.col("level") < DEPTH) & (own | near)


def _opened(front: DataFrame, cells: DataFrame, level: int, n_cells: int, theta: float, side: float) -> DataFrame:
    """The pairs below those that have to be opened; ``level`` is theirs."""
    box = ["block", "x0", "x1", "y0", "y1", "lo", "hi"]
    below = cells.where(F.col("level") == level).select(F.shiftright("code", 2).alias("__up"), *[F.col(c).alias(f"__{c}") for c in ("level", "code", "n", "cx", "cy")])
    opened = front.where(_may_open(theta, side)).select(*box, F.col("code").alias("__of"))
    if n_cells <= MOST_CELLS:
        found = opened.join(F.broadcast(below), F.col("__of") == F.col("__up"))
    else:  # many blocks may open one cell
        salted = below.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = opened.withColumn("__at", F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int")).join(salted, (F.col("__of") == F.col("__up")) & (F.col("__at") == F.col("__salt")))
    return found.select(*box, *[F.col(f"__{c}").alias(c) for c in ("level", "code", "n", "cx", "cy")])


def gathered(blocks: DataFrame, cells: DataFrame, theta: float, side: float) -> list[DataFrame]:
    """Tables (block, its box, level, code, n, cx, cy) of the cells that each block's points may look at; written, some levels at once."""
    many = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}  # a row for each of 25 levels
    front = blocks.select("block", "x0", "x1", "y0", "y1", "lo", "hi").crossJoin(F.broadcast(cells.where("level = 0").select("level", "code", "n", "cx", "cy")))
    out, level = [], 0
    while level in many:
        joined = front
        for level in range(level + 1, level + LEVELS_AT_ONCE):
            if level not in many:
                break
            front = _opened(front, cells, level, many[level], theta, side)
            joined = joined.union(front)
        else:
            level += 1
        out.append(materialize(joined, "tree-looked-at"))
        last = out[-1].where(F.col("level") == level - 1)
        if level not in many or last.where(_may_open(theta, side)).isEmpty():
            break
        front = _opened(last, cells, level, many[level], theta, side)
    return out


def repulsion(positions: DataFrame, theta: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, rx, ry, z): sums of q^2 (y_i - y_j) and of q over the other points, cells of a width below ``theta`` times their distance standing for their points.

    ``positions`` is (id, x, y), ids distinct. An empty table gives none; a single
    point's sums are 0. Written.
    """
    low, side = _square(positions)
    blocks = blocks_of(positions, low, side, block_rows)
    cells = cells_of(blocks)
    looked = gathered(blocks, cells, theta, side)
    pairs = blocks.limit(0).select(F.col("block").alias("of"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    for part in looked:
        part = part.select(F.col("block").alias("of"), "level", "code", "n", "cx", "cy")
        pairs = pairs.union(part)

    def feel(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "rx": pd.Series(dtype="float64"), "ry": pd.Series(dtype="float64"), "z": pd.Series(dtype="float64")})
        ids, code, at = np.frombuffer(p["ids"].iloc[0], np.int64), np.frombuffer(p["codes"].iloc[0], np.int64), np.frombuffer(p["at"].iloc[0]).reshape(-1, 2)
        q = q.sort_values(["level", "code"], kind="stable")
        level, codes, n, centres = q["level"].to_numpy(), q["code"].to_numpy().astype(np.uint64), q["n"].to_numpy(), q[["cx", "cy"]].to_numpy(float)
        cut = np.searchsorted(level, np.arange(level.max() + 2))
        levels = [(codes[a:b], n[a:b], centres[a:b]) for a, b in zip(cut, cut[1:])]
        force, total = walk(at, code.astype(np.uint64), levels, side, theta)
        return pd.DataFrame({"id": ids, "rx": force[:, 0], "ry": force[:, 1], "z": total})

    out = materialize(blocks.select("block", "ids", "codes", "at").groupBy("block").cogroup(pairs.groupBy("of")).applyInPandas(feel, "id long, rx double, ry double, z double"), "repulsion")
    discard(cells, blocks, *looked)
    return out
