"""Geodesics against published lines, quadrants of the ellipsoid and there-and-back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import geodesy

BESSEL, INTERNATIONAL, GRS80 = (6377397.155, 1 / 299.1528128), (6378388.0, 1 / 297.0), (6378137.0, 1 / 298.257222101)


def deg(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 or str(d) == "-0.0" else 1)


#: Published test lines (ellipsoid, latitudes, difference of longitude, metres).
LINES = [
    (BESSEL, deg(55, 45, 0), deg(-33, 26, 0), deg(108, 13, 0), 14110526.170),
    (INTERNATIONAL, deg(37, 19, 54.95367), deg(26, 7, 42.83946), deg(41, 28, 35.50729), 4085966.703),
    (INTERNATIONAL, deg(35, 16, 11.24862), deg(67, 22, 14.77638), deg(137, 47, 28.31435), 8084823.839),
    (INTERNATIONAL, deg(1, 0, 0), deg(-0.0, 59, 53.83076), deg(179, 17, 48.02997), 19960000.000),
    (INTERNATIONAL, deg(1, 0, 0), deg(1, 1, 15.18952), deg(179, 46, 17.84244), 19780006.5584),
    (GRS80, deg(-37, 57, 3.72030), deg(-37, 39, 10.15610), deg(143, 55, 35.38390) - deg(144, 25, 29.52440), 54972.271),
]


@pytest.mark.parametrize("line", LINES)
def test_published_lines(line):
    ellipsoid, a, b, apart, metres = line
    got, _ = geodesy.inverse(*(np.array([x]) for x in (a, 10.0, b, 10.0 + apart)), ellipsoid)
    assert got[0] == pytest.approx(metres, abs=1e-3)


def test_poles_equator_and_antipodes():
    a, f = geodesy.WGS84
    pairs = np.array([(0, 0, 0, 90), (0, 0, 90, 0), (90, 5, -90, 77), (0, 0, 0, 180), (30, 20, -30, -160), (12, 7, 12, 7), (0, 179.5, 0, -179.5)], float)
    got, turn = geodesy.inverse(*pairs.T)
    quarter = 10001965.7293  # fixed value: a quarter of a meridian of WGS 84
    assert got == pytest.approx([a * np.pi / 2, quarter, 2 * quarter, 2 * quarter, 2 * quarter, 0, a * np.pi / 180], abs=2e-3)
    assert min(turn[3], 360 - turn[3]) < 0.01 or abs(turn[3] - 180) < 0.01


def test_there_and_back():
    rng = np.random.default_rng(1)
    lat, lng = np.degrees(np.arcsin(rng.uniform(-1, 1, 3000))), rng.uniform(-180, 180, 3000)
    turn, metres = rng.uniform(0, 360, 3000), 10 ** rng.uniform(0, 7.2, 3000)
    b, o = geodesy.ends(lat, lng, turn, metres)
    got, first = geodesy.inverse(lat, lng, b, o)
    assert np.abs(got - metres).max() < 1e-3
    assert np.abs(((first - turn + 180) % 360 - 180) * np.minimum(metres, 1e6)).max() < 1


def test_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (float("nan"), 0.0, 0.0, 1.0), (91.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    rows = [r[0] for r in df.select(geodesy.distance_m(*(F.col(x) for x in "abcd"))).collect()]
    assert rows[0] == pytest.approx(111319.4908, abs=1e-3) and rows[1:] == [None] * 3
    end = df.select(geodesy.end_point(F.col("a"), F.col("b"), F.lit(90.0), F.lit(111319.4908)).alias("p")).first()["p"]
    assert (end["lat"], end["lng"]) == pytest.approx((0, 1), abs=1e-8)
