"""Bindings of the hexagonal cells: parts are points of a region, suppliers carry rings in degrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geodesy, hexcells
from ..sources import cells as ids
from .bindings import query, read


def _points(spark, d):
    """Points of a region of 8 by 10 degrees, without a pentagon."""
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("point"), (44 + (F.col("p_partkey") * 7919) % 8009 / 1001).alias("lat"), (-128 + (F.col("p_partkey") * 104729) % 10007 / 1001).alias("lng"))


@query(None)
def cells_of_points(spark, d):
    """(point, cell, parent, lat, lng): cells of resolution 8, their parents of resolution 6 and their centres."""
    c = _points(spark, d).withColumn("cell", hexcells.cell_at(F.col("lat"), F.col("lng"), 8))
    return c.select("point", ids.to_text(F.col("cell")).alias("cell"), ids.to_text(ids.parent(F.col("cell"), 6)).alias("parent"), hexcells.centre(F.col("cell")).alias("c")).select("point", "cell", "parent", "c.lat", "c.lng")


@query("SELECT s_suppkey AS point, h AS hops, CASE WHEN h = 0 THEN 1 ELSE 6 * h END::BIGINT AS cells FROM supplier, (VALUES (0), (1), (2), (3)) AS v(h)")
def cell_disk_sizes(spark, d):
    """Rings of cells of resolution 9 around each supplier; away from pentagons each ring has six more than the one before."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), (44 + (F.col("s_suppkey") * 7919) % 8009 / 1001).alias("lat"), (-128 + (F.col("s_suppkey") * 104729) % 10007 / 1001).alias("lng"))
    s = s.withColumn("cell", hexcells.cell_at(F.col("lat"), F.col("lng"), 9)).select("point", "cell")
    counted = hexcells.disks(s, "cell", 3).groupBy("origin", "hops").agg(F.count_distinct("cell").alias("cells"))
    return s.join(counted, F.col("cell") == F.col("origin")).select("point", "hops", "cells")


@query(None)
def cell_covers(spark, d):
    """(poly, cell, inside): cells of resolution 6 that meet a supplier's box in degrees, and whether their centre lies in it."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("poly"))
    corner = lambda x, y: f"struct(-128 + (poly * 104729) % 1000 / 100D + {x} AS x, 44 + (poly * 7919) % 800 / 100D + {y} AS y)"
    rings = s.withColumn("ring", F.expr(f"array({corner(0, 0)}, {corner('(poly % 7) / 10D', 0.05)}, {corner('(poly % 7) / 10D', 0.3)}, {corner(0.05, 0.25)})"))
    met = hexcells.cover(rings, "poly", 6, overlap=True, size=0.5)
    inside = hexcells.cover(rings, "poly", 6, size=0.5).withColumn("inside", F.lit(True))
    return met.join(inside, ["poly", "cell"], "left").select("poly", ids.to_text(F.col("cell")).alias("cell"), F.coalesce("inside", F.lit(False)).alias("inside"))


_F, _A = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
_PAIRS = """p AS (SELECT p_partkey AS id, radians((p_partkey * 7919) % 1201 / 10.0::DOUBLE - 60) AS lat1, radians((p_partkey * 104729) % 3600 / 10.0::DOUBLE - 180) AS lng1,
  radians((p_partkey * 3571) % 1201 / 10.0::DOUBLE - 60) AS lat2, radians((p_partkey * 104729) % 3600 / 10.0::DOUBLE - 180 + (p_partkey * 2903) % 1600 / 10.0::DOUBLE) AS lng2 FROM part)"""
_STEP = """sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs"""
_ANGLES = """atan2(ss, cs) AS s, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa"""


@query(f"""WITH RECURSIVE {_PAIRS}, u AS (SELECT id, atan((1 - {_F}) * tan(lat1)) AS u1, atan((1 - {_F}) * tan(lat2)) AS u2, lng2 - lng1 AS apart FROM p),
it AS (SELECT id, u1, u2, apart, apart AS lam, 0 AS k FROM u
  UNION ALL SELECT id, u1, u2, apart, apart + (1 - c) * {_F} * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1))), k + 1 FROM (
    SELECT *, {_F} / 16 * c2 * (4 + {_F} * (4 - 3 * c2)) AS c, CASE WHEN c2 > 1e-20 THEN cs - 2 * sin(u1) * sin(u2) / c2 ELSE 0 END AS cm FROM (
      SELECT *, 1 - sa * sa AS c2 FROM (SELECT *, {_ANGLES} FROM (SELECT *, {_STEP} FROM it WHERE k < 40))))),
l AS (SELECT *, CASE WHEN c2 > 1e-20 THEN cs - 2 * sin(u1) * sin(u2) / c2 ELSE 0 END AS cm, c2 * ({_A} ** 2 - ({_A} * (1 - {_F})) ** 2) / ({_A} * (1 - {_F})) ** 2 AS q FROM (SELECT *, 1 - sa * sa AS c2 FROM (SELECT *, {_ANGLES} FROM (SELECT *, {_STEP} FROM it WHERE k = 40)))),
m AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS ba, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM l)
SELECT id, round({_A} * (1 - {_F}) * ba * (s - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS metres FROM m""")
def geodesic_distances(spark, d):
    """Metres on the ellipsoid between two points of every part."""
    k = F.col("p_partkey")
    lng = (k * 104729) % 3600 / 10.0 - 180
    p = read(spark, d, "part").select(k.alias("id"), geodesy.distance_m((k * 7919) % 1201 / 10.0 - 60, lng, (k * 3571) % 1201 / 10.0 - 60, lng + (k * 2903) % 1600 / 10.0).alias("metres"))
    return p.select("id", F.round("metres", 3).alias("metres"))
