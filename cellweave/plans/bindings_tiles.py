"""Bindings of binary rasters: parts as pixels, written as TIFF tiles and read back by block."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..core import shared_folder
from ..sources import tiles
from .bindings import query, read, rounded
from .bindings_more import _GRID, _grid

#: Pixels of a tile's side, rows of a strip.
TILE, STRIP = 32, 5


def _written(spark, d) -> str:
    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    tiles.write_tiles(_grid(spark, d), folder, TILE, STRIP).write.format("noop").mode("overwrite").save()
    return folder


_NEAR = f"row // {TILE} = g.row // {TILE} AND {{0}}.col // {TILE} = g.col // {TILE}"


@query(f"""WITH {_GRID} SELECT g.row, g.col, round(degrees(atan(sqrt(power((e.value - w.value) / 60.0::DOUBLE, 2) + power((s.value - n.value) / 50.0::DOUBLE, 2)))), 6) AS slope FROM grid g
LEFT JOIN grid s ON s.row = g.row + 1 AND s.col = g.col AND s.{_NEAR.format('s')} LEFT JOIN grid n ON n.row = g.row - 1 AND n.col = g.col AND n.{_NEAR.format('n')}
LEFT JOIN grid e ON e.row = g.row AND e.col = g.col + 1 AND e.{_NEAR.format('e')} LEFT JOIN grid w ON w.row = g.row AND w.col = g.col - 1 AND w.{_NEAR.format('w')}""")
def tiled_raster_gradient(spark, d):
    """Slopes of pixels from their halo, with no join; a file's border has no neighbour."""
    p = tiles.tiff(spark, _written(spark, d), halo=True).where("value IS NOT NULL")
    gy, gx = (F.col("south") - F.col("north")) / 50.0, (F.col("east") - F.col("west")) / 60.0
    at = p.select(F.floor(-F.col("y")).alias("row"), F.floor("x").alias("col"), F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"))
    return rounded(at)


@query(f"""WITH {_GRID}, b AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 37 AS x, (s_suppkey * 13) % 50 AS y FROM supplier)
SELECT id, count(*) AS pixels, round(sum(value), 6) AS total FROM b JOIN grid ON col + 0.5 BETWEEN x AND x + 3 AND row + 0.5 BETWEEN y AND y + 2 GROUP BY id""")
def block_selected_pixels(spark, d):
    """Sums of pixels in suppliers' boxes: only blocks that meet a box are read."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k.alias("id"), ((k * 7) % 37).cast("double").alias("x_low"), (-((k * 13) % 50) - 2).cast("double").alias("y_low"))
    boxes = s.withColumn("x_high", F.col("x_low") + 3).withColumn("y_high", F.col("y_low") + 2)
    chosen = tiles.blocks_that_meet(tiles.block_index(spark, _written(spark, d)), boxes, float(TILE))
    pixels = tiles.pixels_of_blocks(chosen).where("value IS NOT NULL").select("x", "y", "value")
    # a pixel's cell of one step, and the cells of each box
    cells = boxes.select("id", F.explode(F.sequence(F.col("x_low").cast("long"), F.col("x_high").cast("long") - 1)).alias("i"), "y_low").select("id", "i", F.explode(F.sequence(F.col("y_low").cast("long"), F.col("y_low").cast("long") + 1)).alias("j"))
    met = pixels.select(F.floor("x").alias("i"), F.floor("y").alias("j"), "value").join(cells, ["i", "j"])
    return rounded(met.groupBy("id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("total")))
