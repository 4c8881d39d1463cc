"""Shortest ways with their nodes against a plain search; sections and widths against known shapes."""

import heapq
import random

import pytest

from cellweave.operators import paths, polygons, sections


def plain(edges, src, dst, limit):
    """Length and nodes of the way, of equal ones that with the smallest nodes from its end."""
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    dist, queue = {src: 0}, [(0, src)]
    while queue:
        d, n = heapq.heappop(queue)
        if d > dist[n]:
            continue
        for m, w in out.get(n, ()):
            if d + w <= limit and d + w < dist.get(m, limit + 1):
                dist[m] = d + w
                heapq.heappush(queue, (d + w, m))
    if dst not in dist:
        return None, []
    way = [dst]
    while way[-1] != src:
        way.append(min(a for a, b, w in edges if b == way[-1] and a in dist and dist[a] + w == dist[b]))
    return dist[dst], way[::-1]


def test_ways_against_a_plain_search(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60), r.randint(1, 4)) for _ in range(240)] + [(k, k + 1, 1) for k in range(100, 110)]
    edges = list({(a, b): (a, b, w) for a, b, w in sorted(edges, reverse=True) if a != b}.values())
    legs = [(k, r.randrange(60), r.randrange(60)) for k in range(20)] + [(90, 100, 110), (91, 110, 100), (92, 7, 7)]
    ways, summary = paths.shortest(spark.createDataFrame(edges, "src long, dst long, w long"), spark.createDataFrame(legs, "leg long, src long, dst long"), 14)
    got = {}
    for x in sorted(ways.collect(), key=lambda x: (x["leg"], x["step"])):
        got.setdefault(x["leg"], []).append(x["node"])
    status = {x["leg"]: (x["length"], x["hops"], x["status"]) for x in summary.collect()}
    for leg, a, b in legs:
        length, way = plain(edges, a, b, 14)
        assert got.get(leg, []) == way
        assert status[leg] == ((length, len(way) - 1, "reachable") if way else (None, None, "no_path_within_limit"))


def test_weights_must_be_positive(spark):
    with pytest.raises(Exception, match="above 0"):
        paths.shortest(spark.createDataFrame([(1, 2, 0)], "src long, dst long, w long"), spark.createDataFrame([(1, 1, 2)], "leg long, src long, dst long"), 5)


def test_routes_through_anchors_in_water(spark):
    # a ring of water around an island, and a lone pond
    cells = [(r, c) for r in range(7) for c in range(7) if not (2 <= r <= 4 and 2 <= c <= 4)] + [(20, 20)]
    wet = spark.createDataFrame([(r, c, 10.0) for r, c in cells], "row long, col long, clearance double")
    steps = paths.water_steps(wet, 100, 10)
    rows = {(x["src"], x["dst"]): x["w"] for x in steps.collect()}
    want = set()
    for r, c in cells:
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if (a or b) and {(r + a, c + b), (r + a, c), (r, c + b)} <= set(cells):
                    want.add((r * 100 + c, (r + a) * 100 + c + b))
    assert set(rows) == want and rows[(0, 1)] == 20000 and rows[(0, 101)] == 28284
    anchors = [("round", 1, 0), ("round", 2, 606), ("round", 3, 600), ("back", 1, 0), ("back", 2, 3), ("back", 3, 1), ("cut", 1, 0), ("cut", 2, 2020), ("one", 1, 5)]
    whole, status = paths.routes(spark.createDataFrame(anchors, "route string, seq int, node long"), steps, 10**6)
    got = {x["route"]: (x["length"], x["status"]) for x in status.collect()}
    assert got["cut"] == (None, "leg_without_path") and got["back"] == (100000, "repeated_node") and got["round"][1] == "found" and "one" not in got
    line = sorted((x["step"], x["node"], x["dist"]) for x in whole.where("route = 'round'").collect())
    assert [x[0] for x in line] == list(range(len(line))) and line[0][1] == 0 and line[-1][1] == 600 and line[-1][2] == got["round"][0]
    for (_, a, d), (_, b, e) in zip(line, line[1:]):
        assert e - d == rows[(a, b)]
    assert whole.where("route = 'cut'").count() == 0


def square(x, y, w, h):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def test_sections_and_widths(spark):
    lines = [
        (1, [(0.0, 0.0), (50.0, 0.0), (100.0, 0.0)], True),  # a river 10 wide, with an islet's gap at its mouth
        (2, [(0.0, 100.0), (0.0, 100.0), (0.0, 140.0)], False),  # up, a point twice
        (3, [(5.0, 5.0), (5.0, 5.0)], True),  # no length
        (4, [(500.0, 500.0), (520.0, 500.0), (520.0, 520.0)], True),  # bent, away from all polygons
    ]
    line = "id int, line array<struct<x: double, y: double>>, at_end boolean"
    across = sections.cross_sections(spark.createDataFrame(lines, line), [10.0, 30.0, 500.0], 40.0)
    got = {(r["id"], r["bearing"]): tuple(round(r[k], 6) + 0.0 for k in ("x", "y", "dx", "dy")) for r in across.collect()}
    assert got[1, 0] == (90.0, -20.0, 0.0, 40.0) and got[1, 2] == (10.0, -20.0, 0.0, 40.0)
    assert got[2, 0] == (20.0, 110.0, -40.0, 0.0) and got[2, 2] == (20.0, 136.0, -40.0, 0.0)
    assert got[4, 2] == (504.0, 480.0, 0.0, 40.0) and {k[0] for k in got} == {1, 2, 4}
    shapes = [square(0, -5, 80, 10), square(40, -5, 40, 8), square(80, 1, 20, 4), square(80, -9, 20, 5), square(-3, 90, 3, 60), square(0, 90, 4, 60), square(8, 90, 4, 60)]
    rings = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)], "poly int, ring array<struct<x: double, y: double>>")
    pieces = {}
    for r in sections.wet_pieces(across, polygons.edges(rings), 16.0).collect():
        pieces.setdefault((r["id"], r["bearing"]), []).append((round(r["a"] * 40, 6), round(r["b"] * 40, 6)))
    assert sorted(pieces[1, 0]) == [(11.0, 16.0), (21.0, 25.0)] and pieces[1, 1] == [(15.0, 25.0)]
    assert sorted(pieces[2, 0]) == [(8.0, 12.0), (16.0, 23.0)]  # neighbours that share a border are one
    wide = {r["id"]: (round(r["width"], 6), r["samples"]) for r in sections.widths(across, polygons.edges(rings), 40.0, 3.0, 16.0).collect()}
    assert wide == {1: (10.0, 3), 2: (7.0, 3)}
