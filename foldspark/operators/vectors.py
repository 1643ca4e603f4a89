"""Array expressions for vectors, and bit and grid expressions for points in the plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """To length 1; a zero vector stays."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)), 1)


def _spread_bits(v: Column) -> Column:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def cell_of(v: Column, low: Column, side: Column, cells: int) -> Column:
    """The cell, 0 to cells - 1, of a coordinate in a grid over [low, low + side]."""
    return F.least(F.greatest(F.floor((v - low) / side * cells), F.lit(0)), F.lit(cells - 1)).cast("long")


def morton(cx: Column, cy: Column) -> Column:
    """Interleaved bits of two 16-bit cells."""
    return _spread_bits(cx).bitwiseOR(F.shiftleft(_spread_bits(cy), 1))


def lagrange_weights(t: Column, nodes: int = 3) -> Column:
    """Weights of equally spaced nodes for a place t in [0, 1) of a box."""
    at = [(k + 0.5) / nodes for k in range(nodes)]
    out = []
    for k in range(nodes):
        w = F.lit(1.0)
        for m in range(nodes):
            if m != k:
                w = w * ((t - at[m]) / (at[k] - at[m]))
        out.append(w)
    return F.array(*out)
