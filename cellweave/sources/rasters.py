"""Sampled grids as long tables (row, col, value): halos, gradients, bilinear samples, contours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shifted(grid: DataFrame, dr: int, dc: int, name: str) -> DataFrame:
    return grid.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("value").alias(name))


def gradient(grid: DataFrame, dy: float, dx: float) -> DataFrame:
    """(row, col, slope): central differences; null beside a missing neighbour."""
    g = grid
    for dr, dc, name in ((1, 0, "s"), (-1, 0, "n"), (0, 1, "e"), (0, -1, "w")):
        g = g.join(_shifted(grid, dr, dc, name), ["row", "col"], "left")
    gy, gx = (F.col("s") - F.col("n")) / (2 * dy), (F.col("e") - F.col("w")) / (2 * dx)
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"))


def bilinear(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(id, value): four-neighbour weights renormalised over the known neighbours; points have id, r, c."""
    base = points.select("id", F.floor("r").alias("r0"), F.floor("c").alias("c0"), (F.col("r") - F.floor("r")).alias("fr"), (F.col("c") - F.floor("c")).alias("fc"))
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    four = base.select("*", F.inline(corners)).select("id", (F.col("r0") + F.col("a")).alias("row"), (F.col("c0") + F.col("b")).alias("col"), (F.when(F.col("a") == 1, F.col("fr")).otherwise(1 - F.col("fr")) * F.when(F.col("b") == 1, F.col("fc")).otherwise(1 - F.col("fc"))).alias("weight"))
    known = four.join(grid, ["row", "col"], "left").withColumn("ok", F.col("value").isNotNull())
    made = known.groupBy("id").agg(F.sum(F.when(F.col("ok"), F.col("weight") * F.col("value"))).alias("t"), F.sum(F.when(F.col("ok"), F.col("weight"))).alias("w"))
    return made.select("id", F.when(F.col("w") > 0, F.col("t") / F.col("w")).alias("value"))


def crossings(grid: DataFrame, level: float) -> DataFrame:
    """(row, col, side, at): where the level crosses the edges to the right (0) and below (1), as a fraction of the edge."""
    j = grid.join(_shifted(grid, 0, 1, "right"), ["row", "col"], "left").join(_shifted(grid, 1, 0, "below"), ["row", "col"], "left")
    edges = j.select("row", "col", "value", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("other")), F.struct(F.lit(1).alias("side"), F.col("below").alias("other")))))
    cut = (F.col("value") < level) != (F.col("other") < level)
    return edges.where(cut).select("row", "col", "side", ((level - F.col("value")) / (F.col("other") - F.col("value"))).alias("at"))


def row_runs(grid: DataFrame) -> DataFrame:
    """(row, start, end): maximal runs of positive pixels, the rectangles that a class polygon is made of."""
    from pyspark.sql import Window as W

    w = W.partitionBy("row").orderBy("col")
    hit = grid.where("value > 0").withColumn("g", F.col("col") - F.row_number().over(w))
    return hit.groupBy("row", "g").agg(F.min("col").alias("start"), F.max("col").alias("end")).drop("g")
