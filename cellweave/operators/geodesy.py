"""Distances and end points on an ellipsoid of revolution, by iteration over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half axis in metres and flattening of WGS 84.
WGS84 = (6378137.0, 1 / 298.257223563)
ROUNDS, PRECISION = 100, 1e-13


def _series(u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the distance along the auxiliary sphere."""
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return a, b


def _bend(b: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, cos_m: np.ndarray) -> np.ndarray:
    return b * sin_s * (cos_m + b / 4 * (cos_s * (2 * cos_m**2 - 1) - b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))


def ends(lat: np.ndarray, lng: np.ndarray, azimuth: np.ndarray, metres: np.ndarray, ellipsoid: tuple[float, float] = WGS84) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees, so many metres from points along geodesics that start in a direction (degrees from north)."""
    a, f = ellipsoid
    b = a * (1 - f)
    turn = np.radians(azimuth)
    tan_u = (1 - f) * np.tan(np.radians(lat))
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    start = np.arctan2(tan_u, np.cos(turn))
    sin_a = cos_u * np.sin(turn)
    cos2_a = 1 - sin_a**2
    big_a, big_b = _series(cos2_a * (a**2 - b**2) / b**2)
    first = metres / (b * big_a)
    s = first
    for _ in range(ROUNDS):
        cos_m = np.cos(2 * start + s)
        new = first + _bend(big_b, np.sin(s), np.cos(s), cos_m)
        done = np.abs(new - s).max(initial=0) < PRECISION
        s = new
        if done:
            break
    cos_m = np.cos(2 * start + s)
    sin_s, cos_s = np.sin(s), np.cos(s)
    out_lat = np.arctan2(sin_u * cos_s + cos_u * sin_s * np.cos(turn), (1 - f) * np.hypot(sin_a, sin_u * sin_s - cos_u * cos_s * np.cos(turn)))
    lam = np.arctan2(sin_s * np.sin(turn), cos_u * cos_s - sin_u * sin_s * np.cos(turn))
    c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
    far = lam - (1 - c) * f * sin_a * (s + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
    return np.degrees(out_lat), (lng + np.degrees(far) + 180) % 360 - 180


def _iterated(lat1, lng1, lat2, lng2, ellipsoid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, first azimuth, and whether the iteration came to an end (it does not near antipodes)."""
    a, f = ellipsoid
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    apart = np.radians((lng2 - lng1 + 180) % 360 - 180)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, ended = apart.copy(), np.zeros(len(apart), bool)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, cu1 * cu2 * sl / np.where(sin_s > 0, sin_s, 1), 0)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a > 1e-20, cos_s - 2 * su1 * su2 / np.where(cos2_a > 1e-20, cos2_a, 1), 0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = apart + (1 - c) * f * sin_a * (s + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            ended = np.abs(new - lam) < PRECISION
            lam = np.where(np.isfinite(new), new, lam)
            if ended.all():
                break
        ended &= np.abs(lam) <= np.pi
        big_a, big_b = _series(cos2_a * (a**2 - b**2) / b**2)
        metres = b * big_a * (s - _bend(big_b, sin_s, cos_s, cos_m))
        azimuth = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))) % 360
    return metres, azimuth, ended & np.isfinite(metres)


def inverse(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray, ellipsoid: tuple[float, float] = WGS84) -> tuple[np.ndarray, np.ndarray]:
    """Metres and first azimuth (degrees from north) of shortest geodesics.

    Near antipodes, where the usual iteration does not end, the shortest way is
    sought among all that start from the first point: a quarter of the way round along
    an azimuth, from where the iteration ends again; the azimuth of the least
    sum is bracketed and narrowed. Of equal ways the one east of north counts.
    """
    metres, azimuth, ended = _iterated(lat1, lng1, lat2, lng2, ellipsoid)
    if ended.all():
        return metres, azimuth
    k = np.flatnonzero(~ended)
    p, q, r, s = (x[k] for x in (lat1, lng1, lat2, lng2))
    quarter = np.full(len(k), ellipsoid[0] * np.pi / 2)

    def whole(turn: np.ndarray) -> np.ndarray:
        m, o = ends(p, q, turn, quarter, ellipsoid)
        d, _, good = _iterated(m, o, r, s, ellipsoid)
        return np.where(good, quarter + d, np.inf)

    tried = np.arange(0.0, 360.0, 5.0)
    best = tried[np.argmin(np.stack([np.round(whole(np.full(len(k), t)), 3) for t in tried]), axis=0)]
    low, high, gold = best - 5.0, best + 5.0, (5**0.5 - 1) / 2
    for _ in range(60):
        x, y = high - gold * (high - low), low + gold * (high - low)
        left = whole(x) <= whole(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    metres[k], azimuth[k] = whole((low + high) / 2), ((low + high) / 2) % 360
    return metres, azimuth


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between points in degrees on WGS 84; null where a coordinate is missing, not finite, or a latitude beyond a pole."""

    def made(*columns: pa.Array) -> pa.Array:
        x = [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in columns]
        good = np.isfinite(x[0]) & np.isfinite(x[1]) & np.isfinite(x[2]) & np.isfinite(x[3]) & (np.abs(x[0]) <= 90) & (np.abs(x[2]) <= 90)
        out = np.zeros(len(good))
        if good.any():
            out[good] = inverse(*(c[good] for c in x))[0]
        return pa.array(out, mask=~good)

    return F.arrow_udf(lambda a, b, c, d: made(a, b, c, d), "double")(lat1, lng1, lat2, lng2)


def end_point(lat: Column, lng: Column, azimuth: Column, metres: Column) -> Column:
    """Struct (lat, lng): where a geodesic of a length and direction from a point ends, on WGS 84."""

    def made(*columns: pa.Array) -> pa.Array:
        x = [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in columns]
        good = np.isfinite(np.stack(x)).all(0) & (np.abs(x[0]) <= 90)
        lat, lng = np.zeros(len(good)), np.zeros(len(good))
        if good.any():
            lat[good], lng[good] = ends(*(c[good] for c in x))
        return pa.StructArray.from_arrays([pa.array(lat), pa.array(lng)], names=["lat", "lng"], mask=pa.array(~good))

    return F.arrow_udf(lambda a, b, c, d: made(a, b, c, d), "struct<lat:double,lng:double>")(lat, lng, azimuth, metres)
