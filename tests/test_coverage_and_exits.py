"""Pixel areas against clipping every pixel, first exits against testing every edge."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import coverage, exits, overlay, polygons
from cellweave.operators.contracts import ContractError

RING = "key int, ring array<struct<x:double,y:double>>"


def rings(spark, shapes):
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in shapes], RING)


def star(rng, x, y, n, size):
    return [(x + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def clipped(ring, x0, y0, x1, y1):
    """Area of a ring in a box, side by side."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if b >= 0:
                out.append(q)
        ring = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if ring else 0.0


def test_pixel_areas_equal_clipping_every_pixel(spark):
    rng = random.Random(1)
    shapes = [(1, star(rng, 3.3, 4.1, 13, 9)), (2, [(0, 0), (6, 0), (6, 4), (0, 4)]), (3, [(-2.5, 1.5), (7.25, 1.5), (2, 8)]), (4, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]), (5, [(1, 1), (2, 1), (1, 1)])]
    e = polygons.edges(rings(spark, shapes))
    got = {(r["key"], r["row"], r["col"]): r["area"] for r in coverage.pixel_areas(e, ["key"], 2.0, -1.0, -0.5).collect()}
    for k, ring in shapes:
        for row in range(-8, 12):
            for col in range(-8, 12):
                x, y = -1.0 + 2 * col, -0.5 + 2 * row
                assert got.pop((k, row, col), 0.0) == pytest.approx(clipped(ring, x, y, x + 2, y + 2), abs=1e-9)
    assert not got


def test_depth_areas_and_their_statuses(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    shapes = [(1, square), (2, [(x + 4, y) for x, y in square]), (3, [(x + 50, y) for x, y in square]), (4, [(0, 0), (1, 0), (0, 0)]), (5, square), (5, [(1, 1), (1, 3), (3, 3), (3, 1)])]
    e = polygons.edges(rings(spark, shapes))
    pixels = spark.createDataFrame([(r, c, None if c == 3 else float("nan") if c == 2 and r == 1 else 5.0 + 10 * c) for r in range(2) for c in range(4)], "row int, col int, value double")
    rows = {r["key"]: tuple(r)[1:] for r in coverage.depth_areas(e, ["key"], pixels, 2.0, 15.0).collect()}
    assert rows[1] == (16.0, 16.0, 8.0, 0.5, 1.0, "complete")
    assert rows[2] == (16.0, 4.0, 4.0, 1.0, 0.25, "partial_bathymetry")
    assert rows[3] == (16.0, 0.0, None, None, 0.0, "bathymetry_unavailable")
    assert rows[4] == (0.0, 0.0, None, None, None, "empty_nearshore_support")
    assert rows[5] == (12.0, 12.0, 6.0, 0.5, 1.0, "complete")
    up = pixels.withColumn("value", -F.col("value"))
    assert {r["key"]: tuple(r)[1:] for r in coverage.depth_areas(e, ["key"], up, 2.0, 15.0, "negative_elevation").collect()} == rows
    with pytest.raises(Exception, match="positive-down"):
        coverage.depth_areas(e, ["key"], up, 2.0, 15.0).collect()
    with pytest.raises(ContractError):
        coverage.depth_areas(e, ["key"], pixels, 2.0, -1.0)


def parity(rs, x, y):
    return sum((y0 > y) != (y1 > y) and x < x0 + (x1 - x0) * (y - y0) / (y1 - y0) for r in rs for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1])) % 2 == 1


def searched(x, y, dx, dy, length, water, extent):
    """The first event behind which the middle of the way to the next one is not in both."""
    if not parity(extent, x, y):
        return None, "origin_outside_registered_source_extent"
    if not any(parity([w], x, y) for w in water):
        return None, "origin_not_mapped_water"
    found = {0.0, 1.0}
    for r in [*water, *extent]:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            den = dx * (y1 - y0) - dy * (x1 - x0)
            if abs(den) > 1e-12:
                t, u = ((x0 - x) * (y1 - y0) - (y0 - y) * (x1 - x0)) / den, ((x0 - x) * dy - (y0 - y) * dx) / den
                if 0 < t < 1 and -1e-9 <= u <= 1 + 1e-9:
                    found.add(t)
    events = sorted(found)
    for a, b in zip(events, events[1:]):
        if b - a < 1e-9:
            continue
        m = (a + b) / 2
        p = x + m * dx, y + m * dy
        if not parity(extent, *p):
            return a * length, "source_extent_exit"
        if not any(parity([w], *p) for w in water):
            return a * length, "mapped_geometry_boundary"
    return length, "configured_limit_censored"


def test_first_exits_equal_testing_every_edge(spark):
    rng = random.Random(3)
    water = [star(rng, rng.uniform(0, 40), rng.uniform(0, 40), 9, 11) for _ in range(12)] + [[(0, 0), (20, 0), (20, 20), (0, 20)], [(20, 0), (40, 0), (40, 20), (20, 20)]]
    extent = [[(-3, -4), (36.5, -4), (36.5, 39), (-3, 39)]]
    origins = [(i, rng.uniform(-6, 45), rng.uniform(-6, 45)) for i in range(60)]
    e = lambda rs: polygons.edges(rings(spark, enumerate(rs))).withColumnRenamed("key", "poly")
    rays = exits.spokes(spark.createDataFrame(origins, "id int, x double, y double"), 16, 25.0)
    got = {(r["id"], r["bearing"]): (r["run"], r["boundary_distance"], r["status"]) for r in exits.first_exit(rays, e(water), e(extent), 25.0, 5.0).collect()}
    assert len(got) == 960
    for i, x, y in origins:
        for b in range(16):
            angle = math.radians(b * 22.5)
            run, status = searched(x, y, 25 * math.sin(angle), 25 * math.cos(angle), 25.0, water, extent)
            assert got[i, b][2] == status
            assert got[i, b][0] == (None if run is None else pytest.approx(run, abs=1e-5))
            assert (got[i, b][1] is not None) == (status == "mapped_geometry_boundary")
    assert {s for _, _, s in got.values()} == {"origin_outside_registered_source_extent", "origin_not_mapped_water", "configured_limit_censored", "source_extent_exit", "mapped_geometry_boundary"}


def test_exits_at_borders_and_corners(spark):
    e = lambda rs: polygons.edges(rings(spark, enumerate(rs))).withColumnRenamed("key", "poly")
    water = e([[(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 0), (8, 0), (8, 4), (4, 4)]])
    extent = e([[(-9, -9), (9, -9), (9, 9), (-9, 9)]])
    origins = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 2.0), (3, 4.0, 2.0), (4, 8.0, 4.0)], "id int, x double, y double")
    got = {(r["id"], r["bearing"]): (r["run"], r["status"]) for r in exits.first_exit(exits.spokes(origins, 4, 100.0), water, extent, 100.0, 3.0).collect()}
    shore = "mapped_geometry_boundary"
    assert got[1, 1] == (6.0, shore) and got[1, 3] == (2.0, shore) and got[1, 0] == (2.0, shore)
    assert got[2, 1] == (8.0, shore) and got[2, 3] == (0.0, shore)
    assert got[3, 1] == (4.0, shore) and got[3, 3] == (4.0, shore)
    assert got[4, 1] == (0.0, shore) and got[4, 0] == (0.0, shore)
    assert exits.first_exit(exits.spokes(origins.limit(0), 4, 100.0), water, extent, 100.0, 3.0).count() == 0


def test_overlay_feeds_depth_areas(spark):
    shapes = [(1, [(0, 0), (6, 0), (6, 6), (0, 6)]), (1, [(3, 3), (9, 3), (9, 9), (3, 9)])]
    e = polygons.edges(rings(spark, shapes))
    united = overlay.overlay(e, ["key"], overlay.UNION, 2.0, 1e-3)
    on = coverage.pixel_areas(polygons.edges(united.select("key", "ring")), ["key"], 1.5)
    assert on.agg(F.sum("area")).first()[0] == pytest.approx(63.0) and on.agg(F.max("area")).first()[0] == pytest.approx(2.25)
