"""Hexagonal cells of the icosahedral grid: cell of a point, centre, boundary, neighbours, disks and covers of polygons.

Ids are those of the public H3 grid. Each face of the icosahedron is a plane (gnomonic
projection) with three axes at 120 degrees; a cell's digits walk the hexagons of
seven times finer planes from its base cell's home face, and points beyond a
face's edge are unfolded onto the next face. Only what cannot be derived is a fixed value: the faces, and
the home faces of base cells that several faces share. Base cells are numbered by latitude from north to
south, face neighbours and rotations follow from where the faces' corners lie.

Kernels are array arithmetic over whole Arrow batches; covers and disks are joins
of cells (64-bit ids), so a polygon's cells may come from all tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialise
from ..sources import cells as ids
from . import polygons

# Latitude and longitude of face centres, and azimuth of the first axis there, in radians.
FACES = np.array(
    [
        (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
        (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
        (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
        (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
        (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
        (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
        (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
        (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
        (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
        (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
        (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
        (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
        (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
        (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
        (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
        (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
        (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
        (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
        (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
        (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
    ]
)
# The home faces of the base cells on an edge between two faces.
EDGE_HOMES = {1: 2, 5: 1, 11: 1, 13: 3, 19: 2, 22: 0, 28: 4, 30: 0, 35: 11, 39: 6, 40: 7, 43: 3, 52: 10, 53: 4, 54: 12, 67: 5, 68: 16, 69: 8, 78: 15, 81: 14, 82: 13, 86: 9, 91: 17, 93: 16, 99: 17, 102: 19, 108: 15, 110: 18, 116: 18, 120: 19}
# Home faces of the pentagons, and the two faces on which their missing part is left clockwise.
PENTAGON_HOMES = {4: 0, 14: 11, 24: 10, 38: 12, 49: 14, 58: 13, 63: 6, 72: 7, 83: 5, 97: 8, 107: 9, 117: 19}
CLOCKWISE = {14: (2, 6), 24: (1, 5), 38: (3, 7), 49: (0, 9), 58: (4, 8), 63: (11, 15), 72: (12, 16), 83: (10, 19), 97: (13, 17), 107: (14, 18)}

#: Length of a step of resolution 0 in the plane of a face, and the turn between resolutions.
UNIT = (3 - 5**0.5) / 2
TURN = float(np.arcsin(np.sqrt(3 / 28)))
ROOT7, ROOT3 = 7**0.5, 3**0.5
#: Steps of the digits 0 to 6 along the first two axes (the third is minus their sum), and the digit a sixth of a turn on.
STEPS = np.array([(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)])
ONWARD = np.array([0, 5, 3, 1, 6, 4, 2])
BACK = np.argsort(ONWARD)
CORNERS = np.array([(2, 0), (0, 2), (-2, -2)])


def _plane(steps: np.ndarray) -> np.ndarray:
    """Points of a plane from steps along the first two axes."""
    return np.stack([steps[..., 0] - steps[..., 1] / 2, steps[..., 1] * (ROOT3 / 2)], -1)


def _steps(points: np.ndarray) -> np.ndarray:
    b = points[..., 1] / (ROOT3 / 2)
    return np.stack([points[..., 0] + b / 2, b], -1)


def _turned(points: np.ndarray, angle) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([c * points[..., 0] - s * points[..., 1], s * points[..., 0] + c * points[..., 1]], -1)


def _xyz(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], -1)


def _on_sphere(face: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of plane points, in steps of resolution 0."""
    lat0, lng0, axis = FACES[face].T if np.ndim(face) else FACES[face]
    far = np.arctan(np.hypot(points[..., 0], points[..., 1]) * UNIT)
    azimuth = axis - np.arctan2(points[..., 1], points[..., 0])
    lat = np.arcsin(np.clip(np.sin(lat0) * np.cos(far) + np.cos(lat0) * np.sin(far) * np.cos(azimuth), -1, 1))
    lng = lng0 + np.arctan2(np.sin(azimuth) * np.sin(far) * np.cos(lat0), np.cos(far) - np.sin(lat0) * np.sin(lat))
    return lat, (lng + np.pi) % (2 * np.pi) - np.pi


def _in_plane(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest face, and the point of its plane."""
    dot = _xyz(lat, lng) @ _xyz(FACES[:, 0], FACES[:, 1]).T
    face = np.argmax(dot, -1)
    lat0, lng0, axis = FACES[face].T
    azimuth = np.arctan2(np.cos(lat) * np.sin(lng - lng0), np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lng - lng0))
    far = np.tan(np.arccos(np.clip(np.max(dot, -1), -1, 1))) / UNIT
    return face, np.stack([far * np.cos(axis - azimuth), far * np.sin(axis - azimuth)], -1)


class _Grid:
    """What follows from where the faces lie."""

    def __init__(self) -> None:
        corners = np.array([_xyz(*_on_sphere(f, _plane(CORNERS))) for f in range(20)])
        # across[f, q]: the next face over the edge without corner q, sixths of a turn to its frame, and the shift there
        self.face, self.rot, self.shift = np.zeros((20, 3), int), np.zeros((20, 3), int), np.zeros((20, 3, 2))
        flat = _plane(CORNERS)
        for f in range(20):
            for q in range(3):
                edge = [c for c in range(3) if c != q]
                for g in range(20):
                    same = [[d for d in range(3) if np.allclose(corners[f, c], corners[g, d], atol=1e-6)] for c in edge]
                    if g != f and all(same):
                        ends = flat[[s[0] for s in same]]
                        for n in range(6):
                            turned = _turned(flat[edge], n * np.pi / 3)
                            if np.allclose(ends - turned, ends[0] - turned[0], atol=1e-6):
                                self.face[f, q], self.rot[f, q], self.shift[f, q] = g, n, ends[0] - turned[0]
        # base cells: centres of faces, halfway to their corners, middles of edges, corners
        spots = np.array([(0, 0), (1, 0), (0, 1), (-1, -1), (1, 1), (-1, 0), (0, -1), (2, 0), (0, 2), (-2, -2)])
        found: dict[tuple, list] = {}
        for f in range(20):
            lat, lng = _on_sphere(f, _plane(spots))
            for s, a, o, p in zip(spots, lat, lng, np.round(_xyz(lat, lng), 6) + 0.0):
                found.setdefault(tuple(p), []).append((f, tuple(int(x) for x in s), a, o))
        order = sorted(found.values(), key=lambda places: -places[0][2])
        self.home, self.start, self.pentagon = np.zeros(122, int), np.zeros((122, 2), int), np.zeros(122, bool)
        self.base, self.turns = np.full((20, 7, 7), -1), np.zeros((20, 7, 7), int)
        for number, places in enumerate(order):
            self.pentagon[number] = len(places) == 5
            home = {1: lambda: places[0][0], 2: lambda: EDGE_HOMES[number], 5: lambda: PENTAGON_HOMES[number]}[len(places)]()
            at = {p[0]: p[1] for p in places}
            self.home[number], self.start[number] = home, at[home]
            for f, s in at.items():
                self.base[f, s[0] + 3, s[1] + 3] = number
                if len(places) == 2 and f != home:
                    self.turns[f, s[0] + 3, s[1] + 3] = next(self.rot[f, q] for q in range(3) if self.face[f, q] == home)
            if len(places) == 5:
                # faces anticlockwise around the corner, and the digits that lead to their centres
                a, o = places[0][2:]
                bearing = {f: np.arctan2(np.sin(FACES[f, 1] - o) * np.cos(FACES[f, 0]), np.cos(a) * np.sin(FACES[f, 0]) - np.sin(a) * np.cos(FACES[f, 0]) * np.cos(FACES[f, 1] - o)) for f in at}
                around = sorted(at, key=lambda f: (bearing[home] - bearing[f]) % (2 * np.pi))
                ring = [3, 5, 4, 6, 2]
                for m, f in enumerate(around):
                    inward = {(2, 0): 3, (0, 2): 5, (-2, -2): 6}[at[f]]
                    self.turns[f, at[f][0] + 3, at[f][1] + 3] = (m - ring.index(inward)) % 5
        # places just beyond an edge
        for f in range(20):
            for a in range(-3, 4):
                for b in range(-3, 4):
                    if self.base[f, a + 3, b + 3] < 0:
                        q = _beyond(np.array([[a, b]], float))[0]
                        if q >= 0:
                            there = np.rint(_steps(_turned(_plane(np.array([a, b], float)), self.rot[f, q] * np.pi / 3) + self.shift[f, q])).astype(int)
                            if np.abs(there).max() <= 3 and self.base[self.face[f, q], there[0] + 3, there[1] + 3] >= 0:
                                g = self.face[f, q]
                                self.base[f, a + 3, b + 3] = self.base[g, there[0] + 3, there[1] + 3]
                                self.turns[f, a + 3, b + 3] = self.turns[g, there[0] + 3, there[1] + 3] + self.rot[f, q]
        self.centre = np.array([_on_sphere(h, _plane(s.astype(float))) for h, s in zip(self.home, self.start)])


def _beyond(steps: np.ndarray) -> np.ndarray:
    """The corner opposite to the edge beyond which a place (in steps of resolution 0) lies; -1 inside."""
    third = np.minimum(np.minimum(steps[..., 0], steps[..., 1]), 0)
    i, j, k = steps[..., 0] - third, steps[..., 1] - third, -third
    over = i + j + k > 2 + 1e-9
    return np.where(~over, -1, np.where((k > 1e-12) & (j > 1e-12), 0, np.where(k > 1e-12, 1, 2)))


@lru_cache(maxsize=1)
def _grid() -> _Grid:
    return _Grid()


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit that is not 0 (0: none), by row."""
    if not digits.shape[1]:
        return np.zeros(len(digits), int)
    some = digits != 0
    return np.where(some.any(1), digits[np.arange(len(digits)), some.argmax(1)], 0)


def cells_at(lat: np.ndarray, lng: np.ndarray, res: int) -> np.ndarray:
    """Ids of the cells that hold points in degrees."""
    g, n = _grid(), len(lat)
    face, p = _in_plane(np.radians(lat), np.radians(lng))
    p = p * ROOT7**res
    s = _steps(_turned(p, -TURN) if res % 2 else p)
    q, r = s[:, 0] - s[:, 1], s[:, 1]
    rq, rr, rs = np.rint(q), np.rint(r), np.rint(-q - r)
    dq, dr, ds = np.abs(rq - q), np.abs(rr - r), np.abs(rs + q + r)
    rq, rr = np.where((dq > dr) & (dq > ds), -rr - rs, rq), np.where((dq <= np.maximum(dr, ds)) & (dr > ds), -rq - rs, rr)
    i, j = (rq + rr).astype(np.int64), rr.astype(np.int64)
    digits = np.zeros((n, res), np.int64)
    code = np.full((5, 5), -1)
    code[STEPS[:, 0] + 2, STEPS[:, 1] + 2] = np.arange(7)
    for level in range(res, 0, -1):
        if level % 2:
            u, v = np.rint((3 * i - j) / 7).astype(np.int64), np.rint((i + 2 * j) / 7).astype(np.int64)
            down = 2 * u + v, -u + 3 * v
        else:
            u, v = np.rint((2 * i + j) / 7).astype(np.int64), np.rint((3 * j - i) / 7).astype(np.int64)
            down = 3 * u - v, u + 2 * v
        digits[:, level - 1] = code[i - down[0] + 2, j - down[1] + 2]
        i, j = u, v
    base, turns = g.base[face, i + 3, j + 3], g.turns[face, i + 3, j + 3]
    five = g.pentagon[base]
    gap = five & (_leading(digits) == 1)
    if gap.any():
        cw = np.array([f in CLOCKWISE.get(int(b), ()) for f, b in zip(face[gap], base[gap])])
        digits[gap] = np.where(cw[:, None], BACK[digits[gap]], ONWARD[digits[gap]])
    for k in range(1, 12):
        go = turns >= k
        if not go.any():
            break
        digits[go] = ONWARD[digits[go]]
        again = go & five & (_leading(digits) == 1)
        digits[again] = ONWARD[digits[again]]
    out = (1 << 59) | (res << 52) | (base.astype(np.int64) << 45) | ((1 << (3 * (15 - res))) - 1)
    for level in range(1, res + 1):
        out |= digits[:, level - 1] << (3 * (15 - level))
    return out


def _placed(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Face, place of the centre (steps of resolution 0), resolution and base cell of ids."""
    g = _grid()
    res, base = (cell >> 52) & 15, (cell >> 45) & 127
    top = int(res.max()) if len(res) else 0
    digits = np.stack([np.where(level <= res, (cell >> (3 * (15 - level))) & 7, 0) for level in range(1, top + 1)], 1) if top else np.zeros((len(cell), 0), np.int64)
    five = g.pentagon[base]
    lead = _leading(digits)
    turn = five & (lead == 5)
    digits[turn] = BACK[digits[turn]]
    lead = _leading(digits)
    i, j = g.start[base, 0].astype(np.int64), g.start[base, 1].astype(np.int64)
    for level in range(1, top + 1):
        deeper = level <= res
        a, b = (2 * i + j, -i + 3 * j) if level % 2 else (3 * i - j, i + 2 * j)
        step = STEPS[digits[:, level - 1]]
        i, j = np.where(deeper, a + step[:, 0], i), np.where(deeper, b + step[:, 1], j)
    p = _plane(np.stack([i, j], -1).astype(float)) / (ROOT7**res)[:, None]
    p = np.where((res % 2 == 1)[:, None], _turned(p, TURN), p)
    face, p = _unfolded(g.home[base], p, five & (lead == 4), np.where(five, 6, 1))
    return face, p, res, base


def _unfolded(face: np.ndarray, p: np.ndarray, special: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to the faces on which they lie; ``special``: cells next to the missing part of a pentagon."""
    g, face, p = _grid(), face.copy(), p.copy()
    for k in range(int(rounds.max()) if len(rounds) else 0):
        q = _beyond(_steps(p))
        go = (q >= 0) & (k < rounds)
        if not go.any():
            break
        pivot = np.array([2.0, 0.0])
        about = go & special & (q == 1) & (k == 0)
        p[about] = _turned(p[about] - pivot, -np.pi / 3) + pivot
        p[go] = _turned(p[go], g.rot[face[go], q[go]] * np.pi / 3) + g.shift[face[go], q[go]]
        face[go] = g.face[face[go], q[go]]
    return face, p


def centres(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of cells' centres in degrees."""
    face, p, _, _ = _placed(cell)
    lat, lng = _on_sphere(face, p)
    return np.degrees(lat), np.degrees(lng)


def outlines(cell: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Corners of cells in degrees, anticlockwise; at odd resolutions one more wherever a side crosses an edge between faces."""
    face, p, res, base = _placed(cell)
    five = _grid().pentagon[base] & ((cell & ((1 << 45) - 1)) == (1 << (3 * (15 - res))) - 1)
    angle = np.pi / 6 + np.arange(6) * np.pi / 3
    around = _turned(np.array([[1 / ROOT3, 0.0]]), angle)
    scaled = around[None] / (ROOT7**res)[:, None, None]
    ring = p[:, None] + np.where((res % 2 == 1)[:, None, None], _turned(scaled, TURN), scaled)
    n = len(cell)
    f, q = _unfolded(np.repeat(face, 6), ring.reshape(-1, 2), np.zeros(6 * n, bool), np.repeat(np.where(five, 6, 1), 6))
    lat, lng = (np.degrees(x).reshape(n, 6) for x in _on_sphere(f, q))
    f = f.reshape(n, 6)
    # all sides of an odd resolution's pentagon cross an edge: edges leave its centre at odd multiples of 30 degrees
    bent = five & (res % 2 == 1)
    skew = np.pi / 6 - TURN
    spoke = _turned(np.array([[np.cos(np.pi / 6) / np.cos(skew) / ROOT3, 0.0]]), np.pi / 2 + np.arange(5) * np.pi / 3)
    more = p[bent][:, None] + spoke[None] / (ROOT7 ** res[bent])[:, None, None]
    bend = _on_sphere(*_unfolded(np.repeat(face[bent], 5), more.reshape(-1, 2), np.zeros(5 * len(more), bool), np.full(5 * len(more), 6)))
    extra = {int(c): [np.degrees(x).reshape(-1, 5)[i] for x in bend] for i, c in enumerate(np.flatnonzero(bent))}
    out = []
    for c in range(n):
        lats, lngs = [], []
        for k in range(5 if five[c] else 6):
            lats.append(lat[c, k])
            lngs.append(lng[c, k])
            if c in extra:
                lats.append(extra[c][0][k])
                lngs.append(extra[c][1][k])
            m = (k + 1) % 6
            if res[c] % 2 and not five[c] and f[c, k] != f[c, m]:
                cut = _crossing(ring[c, k], ring[c, m])
                if cut is not None:
                    a, o = _on_sphere(int(face[c]), cut)
                    lats.append(float(np.degrees(a)))
                    lngs.append(float(np.degrees(o)))
        out.append((np.array(lats), np.array(lngs)))
    return out


def _crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Where a side crosses the border of the face, away from its own corners."""
    flat = _plane(CORNERS.astype(float))
    for u, v in ((0, 1), (1, 2), (2, 0)):
        d, e = b - a, flat[v] - flat[u]
        den = d[0] * e[1] - d[1] * e[0]
        if abs(den) > 1e-15:
            t = ((flat[u] - a)[0] * e[1] - (flat[u] - a)[1] * e[0]) / den
            w = ((flat[u] - a)[0] * d[1] - (flat[u] - a)[1] * d[0]) / den
            if 1e-9 < t < 1 - 1e-9 and 0 <= w <= 1:
                return a + t * d
    return None


def neighbours(cell: np.ndarray) -> list[np.ndarray]:
    """Ids of the cells beyond each side (five or six)."""
    lat0, lng0 = (np.radians(x) for x in centres(cell))
    here = _xyz(lat0, lng0)
    out = []
    for c, (lat, lng) in zip(range(len(cell)), outlines(cell)):
        v = _xyz(np.radians(lat), np.radians(lng))
        middle = v + np.roll(v, -1, 0)
        middle /= np.linalg.norm(middle, axis=1)[:, None]
        # a little beyond each side
        beyond = middle + 0.25 * (middle - here[c])
        beyond /= np.linalg.norm(beyond, axis=1)[:, None]
        found = cells_at(np.degrees(np.arcsin(beyond[:, 2])), np.degrees(np.arctan2(beyond[:, 1], beyond[:, 0])), int((cell[c] >> 52) & 15))
        out.append(np.unique(found[found != cell[c]]))
    return out


# --- columns ------------------------------------------------------------------------------------------------


def cell_at(lat: Column, lng: Column, res: int) -> Column:
    """The cell of ``res`` that holds a point in degrees; null where a coordinate is missing or not finite."""

    def made(a: pa.Array, o: pa.Array) -> pa.Array:
        x, y = (np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in (a, o))
        good = np.isfinite(x) & np.isfinite(y)
        out = np.zeros(len(x), np.int64)
        out[good] = cells_at(x[good], y[good], res)
        return pa.array(out, mask=~good)

    return F.arrow_udf(lambda a, o: made(a, o), "bigint")(lat, lng)


def _by_cell(fn, kind: str):
    """A column function of ids; null and what is no id of a cell give null."""

    def made(column: pa.Array) -> pa.Array:
        x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        good = ((x >> 59) & 31 == 1) & (((x >> 45) & 127) < 122)
        return fn(x, good)

    return F.arrow_udf(lambda c: made(c), kind)


def centre(cell: Column) -> Column:
    """Struct (lat, lng) of a cell's centre, in degrees."""

    def fn(x: np.ndarray, good: np.ndarray) -> pa.Array:
        lat, lng = np.zeros(len(x)), np.zeros(len(x))
        lat[good], lng[good] = centres(x[good])
        return pa.StructArray.from_arrays([pa.array(lat), pa.array(lng)], names=["lat", "lng"], mask=pa.array(~good))

    return _by_cell(fn, "struct<lat:double,lng:double>")(cell)


def boundary(cell: Column) -> Column:
    """Array of structs (x: longitude, y: latitude) of a cell's corners: a ring as ``polygons`` takes it."""

    def fn(x: np.ndarray, good: np.ndarray) -> pa.Array:
        found = iter(outlines(x[good]))
        rows = [[{"x": float(o), "y": float(a)} for a, o in zip(*next(found))] if ok else None for ok in good]
        return pa.array(rows, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return _by_cell(fn, "array<struct<x:double,y:double>>")(cell)


def around(cell: Column) -> Column:
    """Array of a cell's neighbours, in order."""

    def fn(x: np.ndarray, good: np.ndarray) -> pa.Array:
        found = iter(neighbours(x[good]))
        return pa.array([next(found).tolist() if ok else None for ok in good], pa.list_(pa.int64()))

    return _by_cell(fn, "array<bigint>")(cell)


def disks(cells: DataFrame, cell: str, hops: int) -> DataFrame:
    """(origin, cell, hops): the cells within ``hops`` steps of each distinct cell, and the least steps."""
    start = cells.select(F.col(cell).alias("origin")).where(F.col(cell).isNotNull()).distinct()
    found = materialise(start.select("origin", F.col("origin").alias("cell"), F.lit(0).alias("hops")))
    front = found
    for h in range(1, hops + 1):
        # each cell's neighbours are found once, however many disks reach it
        near = front.select("cell").distinct().withColumn("next", F.explode(around(F.col("cell"))))
        step = front.join(near, "cell").select("origin", F.col("next").alias("cell")).distinct()
        front = materialise(step.join(found.where(F.col("hops") >= h - 2).select("origin", "cell"), ["origin", "cell"], "left_anti").select("origin", "cell", F.lit(h).alias("hops")))
        found = found.unionByName(front)
    return found


def base_cells() -> list[int]:
    return [(1 << 59) | (b << 45) | ((1 << 45) - 1) for b in range(122)]


def cover(rings: DataFrame, key: str, res: int, ring: str = "ring", overlap: bool = False, size: float = 1.0) -> DataFrame:
    """(key, cell): cells of ``res`` whose centre lies in the polygon (``overlap``: that share a point with it).

    Rings hold x: longitude and y: latitude, straight in these, not across the antimeridian or a pole; several rings of a key
    follow the even-odd rule. From the base cells down, only cells stay
    that may have descendants in the polygon's box: their centres lie within 1.05
    circumradii. The last level is tested exactly.
    """
    spark = rings.sparkSession
    e = materialise(polygons.edges(rings.select(F.col(key).alias("poly"), F.col(ring).alias("ring"))))
    box = polygons.boxes(e, ["poly"])
    level = spark.createDataFrame([(c,) for c in base_cells()], "cell long").crossJoin(box.select("poly", "left", "bottom", "right", "top"))
    for r in range(res + 1):
        if r:
            level = ids.children(level, "cell", r).drop("cell").withColumnRenamed("child", "cell")
        c = level.withColumn("c", centre(F.col("cell")))
        # degrees of latitude that a cell reaches, and of longitude there
        reach = (2.1 if overlap else 1.1) * 12.6 / ROOT7**r
        low = F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.4), F.abs(F.col("c.lat")) + reach))))
        off = F.least(F.abs(F.col("c.lng") - F.least(F.greatest(F.col("c.lng"), "left"), "right")), *(F.abs(F.col("c.lng") + t - F.least(F.greatest(F.col("c.lng") + t, "left"), "right")) for t in (-360.0, 360.0)))
        near = F.col("c.lat").between(F.col("bottom") - reach, F.col("top") + reach) & ((off <= F.lit(reach) / low) | (F.abs(F.col("c.lat")) + reach >= 89))
        level = materialise(c.where(near).drop("c"))
    centred = level.select("poly", "cell").withColumn("c", centre(F.col("cell")))
    points = centred.select("cell", F.col("c.lng").alias("x"), F.col("c.lat").alias("y")).distinct().withColumnRenamed("cell", "point")
    inside = polygons.covering(points, e, size).select("poly", F.col("point").alias("cell"))
    if overlap:
        shapes = polygons.edges(level.select("cell").distinct().withColumn("ring", boundary(F.col("cell"))).withColumnRenamed("cell", "poly"))
        inside = polygons.intersecting(e, shapes, size).select(F.col("a").alias("poly"), F.col("b").alias("cell"))
    return inside.distinct().select(F.col("poly").alias(key), "cell")
