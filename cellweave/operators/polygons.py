"""Polygons as tables of rings and of edges.

A ring is an array of structs (x, y), not closed by a repeated point; an edge
table has keys, poly and x0, y0, x1, y1. Several rings of a polygon follow the
even-odd rule, so a ring inside another one is a hole. Predicates and areas are
joins and sums over edges: candidates meet by tile, tests are exact formulas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import crowds, pairs

EDGE = ("x0", "y0", "x1", "y1")


def edges(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """The columns of ``rings`` but ``ring``, and each edge of the ring, the closing one included; edges without length are left out."""
    pairs = F.expr(f"transform(sequence(1, size({ring})), i -> struct({ring}[i - 1].x AS x0, {ring}[i - 1].y AS y0, {ring}[i % size({ring})].x AS x1, {ring}[i % size({ring})].y AS y1))")
    kept = [c for c in rings.columns if c != ring]
    return rings.where(F.size(ring) > 0).select(*kept, F.inline(pairs)).where("x0 <> x1 OR y0 <> y1")


def measures(e: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, perimeter, cx, cy, n_edges) by the shoelace sums; a polygon without area has no centroid."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    s = e.groupBy(*keys).agg(F.sum(cross).alias("twice"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("mx"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("my"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("perimeter"), F.count(F.lit(1)).alias("n_edges"))
    some = F.col("twice") != 0
    return s.select(*keys, (F.abs("twice") / 2).alias("area"), "perimeter", F.when(some, F.col("mx") / (3 * F.col("twice"))).alias("cx"), F.when(some, F.col("my") / (3 * F.col("twice"))).alias("cy"), "n_edges")


def boxes(e: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, bottom, right, top)."""
    return e.groupBy(*keys).agg(F.min(F.least("x0", "x1")).alias("left"), F.min(F.least("y0", "y1")).alias("bottom"), F.max(F.greatest("x0", "x1")).alias("right"), F.max(F.greatest("y0", "y1")).alias("top"))


def _tile(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def _tiles(df: DataFrame, left: Column, bottom: Column, right: Column, top: Column, size: float) -> DataFrame:
    """``df`` with a row for every tile (tx, ty) that its box meets."""
    wide = df.withColumn("tx", F.explode(F.sequence(_tile(left, size), _tile(right, size))))
    return wide.withColumn("ty", F.explode(F.sequence(_tile(bottom, size), _tile(top, size))))


def box_pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b) of boxes (columns id, left, bottom, right, top) that overlap or touch; they meet by tile, each pair in the tile of the lower left corner that they share."""
    box = ("left", "bottom", "right", "top")
    u = _tiles(a.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in box)), *(F.col(f"a_{c}") for c in box), size)
    v = _tiles(b.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in box)), *(F.col(f"b_{c}") for c in box), size)
    meet = (F.col("a_left") <= F.col("b_right")) & (F.col("b_left") <= F.col("a_right")) & (F.col("a_bottom") <= F.col("b_top")) & (F.col("b_bottom") <= F.col("a_top"))
    corner = (_tile(F.greatest("a_left", "b_left"), size) == F.col("tx")) & (_tile(F.greatest("a_bottom", "b_bottom"), size) == F.col("ty"))
    # the tables are small, their pairs are not: a fixed number of partitions
    n = crowds.width(a)
    return u.repartition(n, "tx", "ty").join(v.repartition(n, "tx", "ty").hint("merge"), ["tx", "ty"]).where(meet & corner).select("a", "b")


def covering(points: DataFrame, e: DataFrame, size: float) -> DataFrame:
    """(point, poly, boundary): polygons that hold a point (columns point, x, y), its boundary included.

    Points on one spot are tried once; spots meet polygons by tile of the box, by blocks of arrays.
    """
    return points.select("point", "x", "y").join(_spots(points, e, size), ["x", "y"]).select("point", "poly", "boundary")


def _spots(points: DataFrame, e: DataFrame, size: float) -> DataFrame:
    return pairs.covered(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct(), e, size)


def assign(points: DataFrame, e: DataFrame, size: float) -> DataFrame:
    """(point, poly, status): the only covering polygon, or why there is none."""
    hits = _spots(points, e, size).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("poly").alias("one"))
    out = points.select("point", "x", "y").join(hits, ["x", "y"], "left")
    return out.select("point", F.when(F.col("n") == 1, F.col("one")).alias("poly"), F.when(F.col("n") == 1, "assigned").when(F.col("n") > 1, "ambiguous").otherwise("unassigned").alias("status"))


def _turn(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    c = F.col
    return F.signum((c(bx) - c(ax)) * (c(cy) - c(ay)) - (c(by) - c(ay)) * (c(cx) - c(ax)))


def _cross() -> Column:
    """Whether the edges (x0, y0, x1, y1) and (u0, v0, u1, v1) share a point."""
    a, b = _turn("x0", "y0", "x1", "y1", "u0", "v0"), _turn("x0", "y0", "x1", "y1", "u1", "v1")
    c, d = _turn("u0", "v0", "u1", "v1", "x0", "y0"), _turn("u0", "v0", "u1", "v1", "x1", "y1")
    box = (F.least("x0", "x1") <= F.greatest("u0", "u1")) & (F.least("u0", "u1") <= F.greatest("x0", "x1")) & (F.least("y0", "y1") <= F.greatest("v0", "v1")) & (F.least("v0", "v1") <= F.greatest("y0", "y1"))
    return (a * b <= 0) & (c * d <= 0) & box


def _edge_tiles(e: DataFrame, size: float, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    return _tiles(e, F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1), size)


def intersecting(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b): polygons of two edge tables that share a point: edges that cross or touch, or one inside the other."""
    u = _edge_tiles(a.select(F.col("poly").alias("a"), *EDGE), size, *EDGE)
    v = _edge_tiles(b.select(F.col("poly").alias("b"), *(F.col(x).alias(y) for x, y in zip(EDGE, ("u0", "v0", "u1", "v1")))), size, "u0", "v0", "u1", "v1")
    crossing = u.join(v, ["tx", "ty"]).where(_cross()).select("a", "b")

    def one(e: DataFrame) -> DataFrame:
        return e.groupBy("poly").agg(F.min(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))).alias("p")).select(F.col("poly").alias("point"), "p.x", "p.y")

    inside = covering(one(a), b, size).select(F.col("point").alias("a"), F.col("poly").alias("b"))
    around = covering(one(b), a, size).select(F.col("poly").alias("a"), F.col("point").alias("b"))
    return crossing.union(inside).union(around).distinct()


def faults(rings: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """(poly, fault): too_few_points, not_finite, repeated_point, self_crossing or none; the first that holds."""
    n = F.size(F.array_distinct(ring))
    bad = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    first = rings.select("poly", F.when(F.coalesce(F.size(ring), F.lit(0)) < 3, "too_few_points").when(bad, "not_finite").when(n < 3, "too_few_points").when(n < F.size(ring), "repeated_point").alias("fault"))
    sound = rings.join(first.where("fault IS NULL").select("poly"), "poly", "left_semi")
    pairs = F.expr(f"transform(sequence(1, size({ring})), i -> struct(i AS k, size({ring}) AS n, {ring}[i - 1].x AS x0, {ring}[i - 1].y AS y0, {ring}[i % size({ring})].x AS x1, {ring}[i % size({ring})].y AS y1))")
    e = sound.select("poly", F.inline(pairs))
    u = _edge_tiles(e, size, *EDGE)
    v = _edge_tiles(e.select("poly", F.col("k").alias("j"), *(F.col(x).alias(y) for x, y in zip(EDGE, ("u0", "v0", "u1", "v1")))), size, "u0", "v0", "u1", "v1")
    apart = (F.col("j") > F.col("k") + 1) & ~((F.col("k") == 1) & (F.col("j") == F.col("n")))
    crossing = u.join(v, ["poly", "tx", "ty"]).where(apart).where(_cross()).select("poly").distinct().withColumn("crossed", F.lit(True))
    return first.join(crossing, "poly", "left").select("poly", F.coalesce("fault", F.when(F.col("crossed"), "self_crossing"), F.lit("none")).alias("fault"))


def _side(ring: str, axis: str, other: str, limit: str, keep: str) -> str:
    """SQL of a ring cut at a line: points with ``axis`` on the kept side of ``limit``, and where edges cross it."""
    p, q, n = f"{ring}[i]", f"{ring}[(i + 1) % size({ring})]", f"size({ring})"
    at = f"{p}.{other} + ({q}.{other} - {p}.{other}) * ({limit} - {p}.{axis}) / ({q}.{axis} - {p}.{axis})"
    cut = f"named_struct('x', {limit}, 'y', {at})" if axis == "x" else f"named_struct('x', {at}, 'y', {limit})"
    return f"if({n} = 0, {ring}, flatten(transform(sequence(0, {n} - 1), i -> array_compact(array(if(({p}.{axis} {keep} {limit}) <> ({q}.{axis} {keep} {limit}), {cut}, null), if({q}.{axis} {keep} {limit}, {q}, null))))))"


def clip(rings: DataFrame, left: str, bottom: str, right: str, top: str, ring: str = "ring") -> DataFrame:
    """``rings`` cut to a rectangle whose borders are columns; a ring outside becomes an empty array.

    The parts of a ring that is not convex may stay joined along the border, which
    changes no area.
    """
    out = rings
    for axis, other, limit, keep in (("x", "y", left, ">="), ("x", "y", right, "<="), ("y", "x", bottom, ">="), ("y", "x", top, "<=")):
        out = out.withColumn(ring, F.expr(_side(ring, axis, other, limit, keep)))
    return out


def ring_area(ring: str = "ring") -> Column:
    """Area of a ring by the shoelace sum; 0 for an empty one."""
    term = f"{ring}[i - 1].x * {ring}[i % size({ring})].y - {ring}[i % size({ring})].x * {ring}[i - 1].y"
    return F.expr(f"if(size({ring}) < 3, 0.0D, abs(aggregate(transform(sequence(1, size({ring})), i -> {term}), 0.0D, (a, b) -> a + b)) / 2)")


def strips(e: DataFrame, keys: list[str], band: float) -> DataFrame:
    """(keys, cover, area): parts of the plane by the number of polygons over them.

    Each key's polygons are cut in bands of x, so that a crowded key is spread over tasks; in a band, at every
    end of an edge and every crossing. In such a slab the edges do not cross; in
    their order from below each polygon is entered and left by turns, and a running sum counts the polygons
    over each strip, whose area is its width times the height in its middle.
    """
    k = [*keys, "band"]
    left = F.col("x0") <= F.col("x1")
    o = e.where("x0 <> x1").select(*keys, "poly", *(F.when(left, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("x0", "x1", "xa"), ("y0", "y1", "ya"), ("x1", "x0", "xb"), ("y1", "y0", "yb"))))
    o = o.withColumn("slope", (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).withColumn("band", F.explode(F.sequence(_tile("xa", band), F.ceil(F.col("xb") / band) - 1)))
    begin, end = F.greatest(F.col("xa"), F.col("band") * band), F.least(F.col("xb"), (F.col("band") + 1) * band)
    o = o.select(*k, "poly", begin.alias("lo"), end.alias("hi"), "slope", (F.col("ya") + (begin - F.col("xa")) * F.col("slope")).alias("y"))
    other = o.select(*k, *(F.col(c).alias(f"{c}2") for c in ("lo", "hi", "slope", "y")))
    met = o.join(other, k).where("slope <> slope2 AND lo < hi2 AND lo2 < hi")
    crossings = met.withColumn("x", F.expr("(y2 - y + slope * lo - slope2 * lo2) / (slope - slope2)")).where("x > lo AND x < hi AND x > lo2 AND x < hi2").select(*k, "x")
    cuts = o.select(*k, F.explode(F.array("lo", "hi")).alias("x")).union(crossings).distinct()
    slabs = cuts.withColumn("to", F.lead("x").over(W.partitionBy(*k).orderBy("x"))).where("to IS NOT NULL")
    inside = slabs.join(o, k).where("lo <= x AND hi >= to").withColumn("mid", F.expr("y + ((x + to) / 2 - lo) * slope"))
    turn = F.when(F.row_number().over(W.partitionBy(*k, "x", "poly").orderBy("mid")) % 2 == 1, 1).otherwise(-1)
    order = W.partitionBy(*k, "x").orderBy("mid", "poly", "slope")
    run = inside.withColumn("turn", turn).withColumn("cover", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("mid").over(order))
    return run.where("next > mid AND cover > 0").groupBy(*keys, "cover").agg(F.sum(F.expr("(to - x) * (next - mid)")).alias("area"))


def union_area(e: DataFrame, keys: list[str], band: float) -> DataFrame:
    """(keys, union_area, overlap_area, total_area): area under any polygon, under several, and summed over polygons."""
    return strips(e, keys, band).groupBy(*keys).agg(F.sum("area").alias("union_area"), F.sum(F.when(F.col("cover") > 1, F.col("area")).otherwise(0.0)).alias("overlap_area"), F.sum(F.col("area") * F.col("cover")).alias("total_area"))


def pair_areas(a: DataFrame, b: DataFrame, size: float, band: float, once: bool = False) -> DataFrame:
    """(a, b, intersection, union, a_only, b_only) of polygons whose boxes meet and that share area (more than rounding makes); with ``once`` of pairs a < b."""
    signed = [pairs.even_odd(e).join(measures(e, ["poly"]).select("poly", F.col("area").alias("own")), "poly") for e in (a, b)]
    found = pairs.shared(*signed, size, once, ("own",)).where("intersection > 1e-9")
    return found.select("a", "b", "intersection", (F.col("area_a") + F.col("area_b") - F.col("intersection")).alias("union"), (F.col("own_a") - F.col("intersection")).alias("a_only"), (F.col("own_b") - F.col("intersection")).alias("b_only"))


def class_shares(e: DataFrame, key: str, label: str, labels: list[str], band: float, slack: float = 1.0) -> DataFrame:
    """Class shares of a key's mapped area, withheld where the classes overlap by more than the slack."""
    by_class = union_area(e, [key, label], band).groupBy(key).agg(*(F.sum(F.when(F.col(label) == c, F.col("union_area"))).alias(f"area_{c}") for c in labels), F.sum("union_area").alias("__all"))
    mapped = union_area(e, [key], band).select(key, F.col("union_area").alias("mapped_area"))
    c = mapped.join(by_class, key).withColumn("excess", F.col("__all") - F.col("mapped_area"))
    clash = F.col("excess") > F.greatest(F.lit(slack), F.col("mapped_area") * 1e-8)
    return c.select(key, "mapped_area", clash.alias("withheld"), *(F.when(~clash, F.coalesce(F.col(f"area_{x}") / F.col("mapped_area"), F.lit(0.0))).alias(f"share_{x}") for x in labels))


def surveyed_share(footprints: DataFrame, cells: DataFrame, key: str, area: str, band: float) -> DataFrame:
    """(key, surveyed_area, surveyed_share, status): the union of footprints against a cell's own area; nothing surveyed is unknown, not 0."""
    u = union_area(footprints, [key], band).select(key, F.col("union_area").alias("surveyed_area"))
    share = F.least(F.lit(1.0), F.col("surveyed_area") / F.col(area))
    out = cells.select(key, area).join(u, key, "left").withColumn("surveyed_share", F.when(F.col(area) > 0, share))
    return out.select(key, "surveyed_area", "surveyed_share", F.when(F.col("surveyed_share").isNull(), "unknown").when(F.col("surveyed_share") >= 1 - 1e-9, "complete").otherwise("partial").alias("status"))
