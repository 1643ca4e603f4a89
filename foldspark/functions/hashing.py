"""A stateless sampler: the same draw as a Column, in numpy and in SQL, whatever the partitioning.

A draw is a mix of unsigned 32-bit products. Spark and DuckDB have signed 64-bit
integers, so products are taken by halves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the node, epoch, edge and draw, then of the two mixing rounds.
NODE, EPOCH, EDGE, DRAW = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F
FIRST, SECOND = 0x7FEB352D, 0x846CA68B
MASK = 0xFFFFFFFF


def _times(x: Column, c: int) -> Column:
    """x * c in 32 bits; x is to be a name, not an expression: it is mentioned twice."""
    high = F.shiftright(x, 16) * F.lit(c)
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + x.bitwiseAND(0xFFFF) * F.lit(c)).bitwiseAND(MASK)


def _steps(start: Column, steps) -> Column:
    """start through all steps, each result being computed once: an array of one element is transformed."""
    held = F.array(start)
    for step in steps:
        held = F.transform(held, step)
    return F.element_at(held, 1)


def draw_column(seed: int, node: Column, epoch: Column, edge: Column, draw: Column, n: int) -> Column:
    """A number from 0 to n - 1 for each row. Inputs are mentioned twice each."""
    h = F.lit(seed & MASK).cast("long")
    for x, c in ((node, NODE), (epoch, EPOCH), (edge, EDGE), (draw, DRAW)):
        h = h.bitwiseXOR(_times(x.cast("long"), c))
    mixed = (lambda h: h.bitwiseXOR(F.shiftright(h, 16)), lambda h: _times(h, FIRST), lambda h: h.bitwiseXOR(F.shiftright(h, 15)), lambda h: _times(h, SECOND), lambda h: h.bitwiseXOR(F.shiftright(h, 16)))
    return _steps(h, mixed) % F.lit(n).cast("long")


def draw_numpy(seed: int, node, epoch, edge, draw, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.uint32(seed & MASK)
        for x, c in ((node, NODE), (epoch, EPOCH), (edge, EDGE), (draw, DRAW)):
            h = h ^ (np.asarray(x).astype(np.uint32) * np.uint32(c))
        h = (h ^ (h >> np.uint32(16))) * np.uint32(FIRST)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(SECOND)
        h = h ^ (h >> np.uint32(16))
        return (h % np.uint32(n)).astype(np.int64)


def draw_sql(seed: int, node: str, epoch: str, edge: str, draw: str, n: str) -> str:
    """The same as a DuckDB expression."""

    def times(x: str, c: int) -> str:
        return f"((((((({x}) >> 16) * {c}) & 65535) << 16) + (({x}) & 65535) * {c}) & {MASK})"

    parts = [times(f"({x})::BIGINT", c) for x, c in ((node, NODE), (epoch, EPOCH), (edge, EDGE), (draw, DRAW))]
    h = f"{seed & MASK}::BIGINT"
    for p in parts:
        h = f"xor({h}, {p})"
    return f"(SELECT xor(h3, h3 >> 16) % ({n}) FROM (SELECT {times('h2', SECOND)} AS h3 FROM (SELECT xor(h1, h1 >> 15) AS h2 FROM (SELECT {times('h0', FIRST)} AS h1 FROM (SELECT xor(h, h >> 16) AS h0 FROM (SELECT {h} AS h))))))"


def _mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over whole arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def normals(seed: int, ids, dims: int) -> np.ndarray:
    """dims standard normal draws for each id, by the Box-Muller transform of two hashes: the same whatever rows come together."""
    with np.errstate(over="ignore"):
        row = _mix64(np.asarray(ids).astype(np.uint64) + np.uint64(seed & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15))
        h = _mix64(row[:, None] + np.arange(1, dims + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
        g = _mix64(h + np.uint64(0xD1B54A32D192ED03))
    u, v = ((h >> np.uint64(11)).astype(float) + 1) / 2**53, (g >> np.uint64(11)).astype(float) / 2**53
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
