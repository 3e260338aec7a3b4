"""Hexagonal cells: bit arithmetic on 64-bit cell ids, and an odd-row lattice in plain columns.

An id has its resolution in bits 52-55 and a base-8 digit for each resolution from bit 42
down; digits past the resolution are 7. Parents and children are bit operations; where a cell
lies is known to ``hexgrid``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINEST = 15
PENTAGONS = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]  # base cells with five neighbours: fixed values
#: Published mean edge lengths of the grid's hexagons in metres, resolution 0 to 15: fixed values.
MEAN_EDGE_M = [1281256.011, 483056.8391, 182512.9565, 68979.22179, 26071.75968, 9854.090990, 3724.532667, 1406.475763, 531.414010, 200.786148, 75.863783, 28.663897, 10.830188, 4.092010, 1.546100, 0.584169]


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def to_hex(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 52).bitwiseAND(15).cast("int")


def parent(cell: Column, level: int) -> Column:
    """The cell of a coarser level that holds it; null if it is coarser itself."""
    unused = (1 << 3 * (FINEST - level)) - 1
    moved = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(level << 52)).bitwiseOR(F.lit(unused))
    return F.when(resolution(cell) >= level, moved)


def center_child(cell: Column, level: int) -> Column:
    """The child at a finer level in the middle: zeros for all new digits; null if it is finer itself."""
    below = F.call_function("shiftleft", F.lit(1).cast("long"), 3 * (FINEST - resolution(cell))) - 1
    new = below.bitwiseAND(F.lit(~((1 << 3 * (FINEST - level)) - 1)))
    out = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(level << 52)).bitwiseAND(F.bitwise_not(new))
    return F.when(resolution(cell) <= level, out)


def base_cell(cell: Column) -> Column:
    """The number of the coarsest cell that holds a cell, 0 to 121."""
    return F.shiftrightunsigned(cell, 45).bitwiseAND(127).cast("int")


def is_pentagon(cell: Column) -> Column:
    """Whether a cell is one of the twelve of its level with five neighbours: in the middle of such a base cell, level by level."""
    unused = F.call_function("shiftleft", F.lit(1).cast("long"), (3 * (FINEST - resolution(cell))).cast("int")) - 1
    digits = cell.bitwiseAND(F.lit((1 << 45) - 1)).bitwiseAND(F.bitwise_not(unused))
    return base_cell(cell).isin(PENTAGONS) & (digits == 0)


def children(cell: Column, level: int) -> Column:
    """The cells one level finer: seven, or six of a pentagon, which lacks digit 1."""
    shift = 3 * (FINEST - level)
    base = cell.bitwiseAND(F.lit(~(15 << 52) & ~(7 << shift))).bitwiseOR(F.lit(level << 52))
    digits = F.when(is_pentagon(cell), F.array(*map(F.lit, (0, 2, 3, 4, 5, 6)))).otherwise(F.sequence(F.lit(0), F.lit(6)))
    return F.when(resolution(cell) == level - 1, F.transform(digits, lambda d: base.bitwiseOR(F.shiftleft(d.cast("long"), shift))))


def mean_edge_m(level: Column) -> Column:
    """The mean edge length of a resolution's hexagons; null for none of 0 to 15."""
    return F.get(F.array(*map(F.lit, MEAN_EDGE_M)), level)


def neighbours(row: Column, column: Column) -> Column:
    """The six (r, c) around a place of the odd-row lattice."""
    odd = F.pmod(row, F.lit(2))
    steps = [(0, -1, None), (0, 1, None), (-1, -1, 1), (-1, 0, 1), (1, -1, 1), (1, 0, 1)]
    return F.array(*(F.struct((row + dr).alias("r"), (column + dc + (odd if shifted else 0)).alias("c")) for dr, dc, shifted in steps))


def lattice_distance(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """Steps between two places of the odd-row lattice."""
    q1, q2 = c1 - F.floor(r1 / 2), c2 - F.floor(r2 / 2)
    dq, dr = q2 - q1, r2 - r1
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("long")
