"""Exact areas of polygons on the pixels of a raster, and depth areas by them.

One pass over the edges: each edge is cut at the lines of its rows and columns, and
a piece adds, to its own pixel, the area left of it there and, to all pixels on its left in
the row, its height. A running sum from the right turns heights into areas, so
no polygon is clipped to any pixel, and pixels between two pieces have one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import polygons
from .contracts import ContractError

#: Areas up to this are none; a valid area short of the whole by no more than the second is all of it.
NONE, SLACK = 1e-9, 1e-6
CONVENTIONS = ("positive_down", "negative_elevation")


def pixel_areas(e: DataFrame, keys: list[str], size: float, left: float = 0.0, bottom: float = 0.0) -> DataFrame:
    """(keys, row, col, area): area of each key's polygons in the pixels that they meet.

    Edges (keys, x0, y0, x1, y1) have the inside on their left (``overlay.oriented``); where polygons
    of a key overlap, the area counts for each. Row and column count from the
    raster's lower left corner; pixels are squares.
    """
    s = e.where("y0 <> y1").select(*keys, *((F.col(c) - (left if c[0] == "x" else bottom)).alias(c) for c in polygons.EDGE))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = s.withColumn("row", F.explode(F.sequence(F.floor(low / size), F.ceil(high / size) - 1)))
    a, b = F.greatest(low, F.col("row") * size), F.least(high, (F.col("row") + 1) * size)
    slope = F.try_divide(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    at = lambda y: F.col("x0") + (y - F.col("y0")) * slope
    up = F.signum(F.col("y1") - F.col("y0"))
    piece = rows.select(*keys, "row", F.least(at(a), at(b)).alias("xl"), F.greatest(at(a), at(b)).alias("xr"), ((b - a) * up).alias("rise")).where("rise <> 0")
    first = F.floor(F.col("xl") / size)
    cols = piece.withColumn("col", F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col("xr") / size) - 1))))
    u, v = F.greatest("xl", F.col("col") * size), F.least("xr", (F.col("col") + 1) * size)
    part = F.when(F.col("xr") > F.col("xl"), F.try_divide(v - u, F.col("xr") - F.col("xl"))).otherwise(1.0)
    own = cols.select(*keys, "row", "col", (F.col("rise") * part).alias("rise"), ((u + v) / 2 - F.col("col") * size).alias("reach"))
    sums = own.groupBy(*keys, "row", "col").agg(F.sum("rise").alias("rise"), F.sum(F.col("rise") * F.col("reach")).alias("own"))
    right = W.partitionBy(*keys, "row").orderBy(F.col("col").desc())
    known = sums.withColumn("beyond", F.coalesce(F.sum("rise").over(right.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("next", F.lag("col").over(right))
    edge = known.select(*keys, "row", "col", (F.col("own") + F.col("beyond") * size).alias("area"))
    # pixels without pieces between two that have some
    between = known.where((F.col("next") > F.col("col") + 1) & (F.abs("beyond") > size * 1e-9))
    filled = between.select(*keys, "row", F.explode(F.sequence(F.col("col") + 1, F.col("next") - 1)).alias("col"), (F.col("beyond") * size).alias("area"))
    return edge.union(filled).where(F.abs("area") > NONE)


def depth_areas(e: DataFrame, keys: list[str], pixels: DataFrame, size: float, threshold: float, convention: str = "positive_down", left: float = 0.0, bottom: float = 0.0) -> DataFrame:
    """(keys, eligible_area, valid_area, deep_area, deep_share, coverage, status) over pixels (row, col, value).

    Valid is what lies on pixels with a depth (null, NaN, infinite: none; of ``negative_elevation`` what is
    not below 0: none), deep what is at least ``threshold`` deep. Statuses: empty_nearshore_support, bathymetry_unavailable, partial_bathymetry, complete.
    """
    if threshold < 0 or convention not in CONVENTIONS:
        raise ContractError(f"threshold may not be negative, convention is one of {CONVENTIONS}")
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if convention == "positive_down":
        depth = F.when(finite & (v < 0), F.raise_error(F.lit("depth raster contradicts positive-down convention"))).when(finite, v)
    else:
        depth = F.when(finite & (v < 0), -v)
    known = pixels.select("row", "col", depth.cast("double").alias("depth"))
    on = pixel_areas(e, keys, size, left, bottom).join(known, ["row", "col"], "left")
    got = on.groupBy(*keys).agg(F.sum(F.when(F.col("depth").isNotNull(), F.col("area")).otherwise(0.0)).alias("valid"), F.sum(F.when(F.col("depth") >= threshold, F.col("area")).otherwise(0.0)).alias("deep"))
    whole = e.groupBy(*keys).agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("eligible"))
    both = whole.join(got, keys, "left").withColumn("valid", F.coalesce("valid", F.lit(0.0)))
    empty, blind = F.col("eligible") <= NONE, F.col("valid") <= NONE
    some: Column = ~empty & ~blind
    status = F.when(empty, "empty_nearshore_support").when(blind, "bathymetry_unavailable").when(F.col("eligible") - F.col("valid") <= SLACK, "complete").otherwise("partial_bathymetry")
    return both.select(
        *keys,
        F.when(empty, 0.0).otherwise(F.col("eligible")).alias("eligible_area"),
        F.when(some, F.col("valid")).otherwise(0.0).alias("valid_area"),
        F.when(some, F.col("deep")).alias("deep_area"),
        F.when(some, F.try_divide("deep", "valid")).alias("deep_share"),
        F.when(some, F.least(F.lit(1.0), F.try_divide("valid", "eligible"))).when(~empty, 0.0).alias("coverage"),
        status.alias("status"),
    )
