"""Hexagonal cells against published values, round trips and testing every cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import hexcells
from cellweave.sources import cells as ids


def text(cells):
    return [format(int(c), "x") for c in cells]


def everywhere(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)


def test_published_values():
    # fixed values: examples of the public grid's documentation
    at = lambda a, o, r: text(hexcells.cells_at(np.array([a]), np.array([o]), r))[0]
    assert at(37.3615593, -122.0553238, 5) == "85283473fffffff"
    assert at(37.3615593, -122.0553238, 7) == "87283472bffffff"
    assert at(37.7752702151959, -122.418307270836, 9) == "8928308280fffff"
    cell = np.array([0x85283473FFFFFFF])
    assert np.allclose(np.ravel(hexcells.centres(cell)), [37.34579337536848, -121.97637597255124])
    lat, lng = hexcells.outlines(cell)[0]
    assert np.allclose(lat, [37.271355866731895, 37.353926450852256, 37.42834118609435, 37.42012867767778, 37.33755608435298, 37.26319797461824])
    assert np.allclose(lng, [-121.91508032705622, -121.86222328902491, -121.9235499963016, -122.0377349642703, -122.09042892904395, -122.02910131])
    assert set(text(hexcells.neighbours(cell)[0])) == {"85283447fffffff", "8528347bfffffff", "85283463fffffff", "85283477fffffff", "8528340ffffffff", "8528340bfffffff"}


@pytest.mark.parametrize("res", range(16))
def test_centres_lie_in_their_cells_and_points_near_their_centres(res):
    lat, lng = everywhere(4000, res)
    cell = hexcells.cells_at(lat, lng, res)
    a, o = hexcells.centres(cell)
    assert (hexcells.cells_at(a, o, res) == cell).all()
    chord = np.linalg.norm(hexcells._xyz(np.radians(lat), np.radians(lng)) - hexcells._xyz(np.radians(a), np.radians(o)), axis=1)
    assert np.degrees(2 * np.arcsin(chord / 2)).max() < 12.6 / 7 ** (res / 2)


@pytest.mark.parametrize("res", [0, 1, 2, 3])
def test_cells_tile_the_sphere(spark, res):
    base = spark.createDataFrame([(c,) for c in hexcells.base_cells()], "cell long")
    cell = np.array([r["child"] for r in ids.children(base, "cell", res).collect()])
    assert len(set(cell.tolist())) == 2 + 120 * 7**res
    lat, lng = hexcells.centres(cell)
    assert (hexcells.cells_at(lat, lng, res) == cell).all()
    total = 0.0
    for a, o in hexcells.outlines(cell):
        v = hexcells._xyz(np.radians(a), np.radians(o))
        m = v.mean(0) / np.linalg.norm(v.mean(0))
        w = np.roll(v, -1, 0)
        total += (2 * np.arctan2(np.cross(v, w) @ m, 1 + v @ m + (v * w).sum(1) + w @ m)).sum()
    assert total == pytest.approx(4 * np.pi, rel=1e-11)
    near = hexcells.neighbours(cell)
    pairs = {(int(c), int(x)) for c, found in zip(cell, near) for x in found}
    assert all((y, x) in pairs for x, y in pairs) and sum(len(x) == 5 for x in near) == 12


def test_columns_of_odd_values(spark):
    df = spark.createDataFrame([(37.3615593, -122.0553238, 0x85283473FFFFFFF), (None, 1.0, None), (float("nan"), 1.0, 0), (1.0, float("inf"), -1)], "lat double, lng double, cell long")
    rows = df.select(hexcells.cell_at(F.col("lat"), F.col("lng"), 5).alias("at"), hexcells.centre(F.col("cell")).alias("c"), hexcells.boundary(F.col("cell")).alias("b"), hexcells.around(F.col("cell")).alias("n")).collect()
    assert rows[0]["at"] == 0x85283473FFFFFFF and len(rows[0]["b"]) == len(rows[0]["n"]) == 6
    assert all(r["at"] is None and r["c"] is None and r["b"] is None and r["n"] is None for r in rows[1:])


def test_disks_of_hexagons_and_pentagons(spark):
    pentagon = int(hexcells.cells_at(np.array([64.7]), np.array([10.536199]), 4)[0])
    df = spark.createDataFrame([(0x85283473FFFFFFF,), (pentagon,), (pentagon,), (None,)], "cell long")
    rows = hexcells.disks(df, "cell", 3).groupBy("origin", "hops").count().collect()
    got = {(r["origin"], r["hops"]): r["count"] for r in rows}
    assert [got[0x85283473FFFFFFF, h] for h in range(4)] == [1, 6, 12, 18]
    assert [got[pentagon, h] for h in range(4)] == [1, 5, 10, 15]


def inside(ring, x, y):
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < x0 + (x1 - x0) * (y - y0) / (y1 - y0):
            hit = not hit
    return hit


def test_covers_equal_testing_every_cell(spark):
    shapes = {1: [(-123.0, 47.0), (-121.0, 47.3), (-121.5, 49.0), (-122.2, 47.8), (-123.5, 48.9)], 2: [(10.0, 63.0), (13.0, 64.0), (9.0, 66.0)], 3: [(0.0, 0.0), (0.01, 0.0), (0.0, 0.01)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in shapes.items()], "key int, ring array<struct<x:double,y:double>>")
    got = {}
    for r in hexcells.cover(df, "key", 5).collect():
        got.setdefault(r["key"], set()).add(r["cell"])
    met = {}
    for r in hexcells.cover(df, "key", 5, overlap=True).collect():
        met.setdefault(r["key"], set()).add(r["cell"])
    for k, ring in shapes.items():
        xs, ys = zip(*ring)
        grid = np.meshgrid(np.linspace(min(xs) - 0.3, max(xs) + 0.3, 500), np.linspace(min(ys) - 0.3, max(ys) + 0.3, 500))
        cell = np.unique(hexcells.cells_at(grid[1].ravel(), grid[0].ravel(), 5))
        lat, lng = hexcells.centres(cell)
        assert got.get(k, set()) == {int(c) for c, a, o in zip(cell, lat, lng) if inside(ring, o, a)}
        # every cell of a point inside meets the polygon, and every cell that meets it has its centre near
        held = [inside(ring, x, y) for x, y in zip(grid[0].ravel()[::7], grid[1].ravel()[::7])]
        some = hexcells.cells_at(grid[1].ravel()[::7][held], grid[0].ravel()[::7][held], 5)
        assert set(some.tolist()) <= met[k] and got.get(k, set()) <= met[k]
    assert 1 <= len(met[3]) <= 3 and 3 not in got
