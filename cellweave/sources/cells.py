"""Hierarchical cell ids by bit arithmetic: resolution and parents need no grid library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_long(text: str | Column) -> Column:
    """The 64-bit id behind its hexadecimal text."""
    return F.conv(F.col(text) if isinstance(text, str) else text, 16, 10).cast("decimal(20,0)").cast("long")


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 52).bitwiseAND(15).cast("int")


def parent(cell: Column, to: int) -> Column:
    """The ancestor at a coarser resolution: the resolution bits replaced and the finer digits set to seven."""
    finer = (1 << (3 * (15 - to))) - 1
    cleared = cell.bitwiseAND(~(15 << 52))
    return cleared.bitwiseOR(F.lit(to << 52)).bitwiseOR(F.lit(finer))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: Base cells that are pentagons; the first axis is deleted in them.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def is_pentagon(cell: Column) -> Column:
    """A pentagon's base cell, and no digit other than 0 down to its resolution."""
    base = F.shiftright(cell, 45).bitwiseAND(127)
    digits = cell.bitwiseAND((1 << 45) - 1)
    unused = F.call_function("shiftright", F.lit((1 << 45) - 1), 3 * resolution(cell))
    return base.isin(*PENTAGONS) & (digits == unused)


def children(cells, cell: str, to: int):
    """The rows of ``cells`` with a row for every descendant of ``cell`` at the finer resolution ``to``, in ``child``; a pentagon has six children."""
    out = cells.withColumn("child", F.col(cell))
    start = out.withColumn("__r", resolution(F.col("child")))
    for r in range(1, to + 1):
        shift = 3 * (15 - r)
        deeper = F.col("__r") < r
        cleared = F.col("child").bitwiseAND(~((15 << 52) | (7 << shift))).bitwiseOR(F.lit(r << 52))
        digits = F.when(deeper, F.when(is_pentagon(F.col("child")), F.array(*map(F.lit, (0, 2, 3, 4, 5, 6)))).otherwise(F.array(*map(F.lit, range(7))))).otherwise(F.array(F.lit(-1)))
        start = start.withColumn("__d", F.explode(digits)).withColumn("child", F.when(F.col("__d") >= 0, cleared.bitwiseOR(F.col("__d").cast("long") * (1 << shift))).otherwise(F.col("child"))).drop("__d")
    return start.drop("__r")
