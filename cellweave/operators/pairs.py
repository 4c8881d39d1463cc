"""Pairs of polygons whose boxes meet, each pair once, by blocks of arrays.

A pair shares all tiles that both boxes meet; it is made in the one that holds the lower left corner of what
the boxes share, so nothing has to be made distinct. Areas follow from edges alone: a polygon is the sum, with
signs, of what lies below its edges, so what two polygons share is the signed sum, over pairs of edges, of what lies below both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import crowds

BOX = ("left", "bottom", "right", "top")
#: Left polygons of a part; edges of a polygon in one row (larger ones have several, whose results are summed).
MOST, EDGES = 512, 64


def tiled(boxes: DataFrame, size: float) -> DataFrame:
    """``boxes`` with a row for every tile (tx, ty) that they meet."""
    t = lambda c: crowds.tile(c, size)
    wide = boxes.withColumn("tx", F.explode(F.sequence(t("left"), t("right"))))
    return wide.withColumn("ty", F.explode(F.sequence(t("bottom"), t("top"))))


def gathered(e: DataFrame, columns: tuple[str, ...], left: str, right: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, left, bottom, right, top, carry..., columns...): polygons, the columns of up to EDGES edges of theirs as arrays; ``carry`` are polygons' own columns."""
    whole = W.partitionBy("poly")
    low, high = ("ya", "yb") if left == "xa" else ("y0", "y1")
    b = e.select("poly", *carry, *columns, F.min(F.least(left, right)).over(whole).alias("left"), F.min(F.least(low, high)).over(whole).alias("bottom"), F.max(F.greatest(left, right)).over(whole).alias("right"), F.max(F.greatest(low, high)).over(whole).alias("top"))
    b = b.withColumn("__k", F.floor((F.row_number().over(whole.orderBy(*columns)) - 1) / EDGES))
    g = b.groupBy(F.col("poly").alias("id"), *BOX, *carry, "__k").agg(F.collect_list(F.struct(*columns)).alias("__e"))
    return g.select("id", *BOX, *carry, *(F.col(f"__e.{c}").alias(c) for c in columns))


def large(e: DataFrame) -> bool:
    """Whether some polygon has more than EDGES edges."""
    return not e.groupBy("poly").count().where(F.col("count") > EDGES).isEmpty()


def _padded(t: pa.Table, columns: tuple[str, ...]) -> list[np.ndarray]:
    """The lists of each column as a row of a matrix, filled with zeros."""
    out = []
    for c in columns:
        lists = t.column(c).combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        rows = np.zeros((len(n), max(1, n.max(initial=0))))
        rows[np.arange(rows.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
        out.append(rows)
    return out


def met(a: DataFrame, b: DataFrame, size: float, columns: tuple[str, ...], kernel: Callable, results: dict[str, type], once: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, results..., and either side's own columns) of the pairs for which ``kernel`` (of the columns of either side, row by row) gives something; with ``once`` of pairs a < b."""

    def rule(p: pa.Table, q: pa.Table) -> pa.Table:
        ids, others = (t.column("id").to_numpy(zero_copy_only=False) for t in (p, q))
        l, m, r, t = (crowds.column(p, c)[:, None] for c in BOX)
        ol, om, or_, ot = (crowds.column(q, c) for c in BOX)
        tx, ty = p.column("tx")[0].as_py() if len(p) else 0, p.column("ty")[0].as_py() if len(p) else 0
        u, v = _padded(p, columns), _padded(q, columns)
        found: list[tuple] = []
        step = max(1, crowds.BLOCK // max(1, u[0].shape[1] * v[0].shape[1]))
        for s in crowds.blocks(len(ids), len(others)):
            meet = (l[s] <= or_) & (ol <= r[s]) & (m[s] <= ot) & (om <= t[s])
            meet &= (np.floor(np.maximum(l[s], ol) / size) == tx) & (np.floor(np.maximum(m[s], om) / size) == ty)
            if once:
                meet &= ids[s, None] < others
            i, j = np.nonzero(meet)
            i += s.start
            for k in range(0, len(i), step):
                x, y = i[k : k + step], j[k : k + step]
                kept, values = kernel([c[x] for c in u], [c[y] for c in v])
                found.append((x[kept], y[kept], *(w[kept] for w in values)))
        cat = [np.concatenate([f[n] for f in found]) if found else np.empty(0, d) for n, d in enumerate((np.int64, np.int64, *results.values()))]
        at = {"a": (p, pa.array(cat[0])), "b": (q, pa.array(cat[1]))}
        return pa.table({"a": p.column("id").take(at["a"][1]), "b": q.column("id").take(at["b"][1]), **{c: pa.array(w) for c, w in zip(results, cat[2:])}, **{f"{c}_{k}": t.column(c).take(n) for c in carry for k, (t, n) in at.items()}})

    kinds = dict(a.dtypes)["id"], dict(b.dtypes)["id"]
    schema = ", ".join([f"a {kinds[0]}, b {kinds[1]}", *(f"{c} double" for c in results), *(f"{c}_{k} double" for c in carry for k in "ab")])
    return crowds.met(tiled(a, size), tiled(b, size), ["tx", "ty"], rule, schema, MOST)


SIGNED = ("xa", "xb", "ya", "yb", "sign")


def facing(e: DataFrame) -> DataFrame:
    """(poly, xa, xb, ya, yb, sign) of edges with the inside on their left: from left to right, 1 above the inside, -1 below it."""
    swap = F.col("x0") > F.col("x1")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return e.where("x0 <> x1").select("poly", pick("x1", "x0").alias("xa"), pick("x0", "x1").alias("xb"), pick("y1", "y0").alias("ya"), pick("y0", "y1").alias("yb"), F.when(swap, 1.0).otherwise(-1.0).alias("sign"))


def even_odd(e: DataFrame) -> DataFrame:
    """The same of any edges, by the even-odd rule: edges are cut where those of their polygon begin, end or cross, and their order tells what is inside."""
    o = facing(e).drop("sign").withColumn("slope", (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).withColumn("k", F.row_number().over(W.partitionBy("poly").orderBy("xa", "ya", "xb", "yb")))
    other = o.select("poly", *(F.col(c).alias(f"{c}2") for c in ("xa", "xb", "ya", "slope", "k")))
    met_ = o.join(other, "poly").where("k < k2 AND slope <> slope2 AND xa < xb2 AND xa2 < xb").withColumn("x", F.expr("(ya2 - ya + slope * xa - slope2 * xa2) / (slope - slope2)")).where("x > xa AND x < xb AND x > xa2 AND x < xb2")
    cuts = o.select("poly", F.explode(F.array("xa", "xb")).alias("x")).union(met_.select("poly", "x")).distinct()
    slabs = cuts.withColumn("to", F.lead("x").over(W.partitionBy("poly").orderBy("x"))).where("to IS NOT NULL")
    at = slabs.join(o, "poly").where("xa <= x AND xb >= to").withColumn("mid", F.expr("ya + ((x + to) / 2 - xa) * slope"))
    sign = F.when(F.row_number().over(W.partitionBy("poly", "x").orderBy("mid", "k")) % 2 == 1, -1.0).otherwise(1.0)
    along = W.partitionBy("poly", "k").orderBy("x")
    # neighbouring cuts of an edge with one sign are one again
    runs = at.withColumn("sign", sign).withColumn("new", F.coalesce((F.lag("sign").over(along) != F.col("sign")).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    one = runs.groupBy("poly", "k", "run", "sign").agg(F.min("x").alias("from"), F.max("to").alias("till"), F.first("xa").alias("x0"), F.first("ya").alias("y0"), F.first("slope").alias("slope"), F.first("xb").alias("x1"), F.first("yb").alias("y1"))
    y = lambda x: F.when(F.col(x) == F.col("x0"), F.col("y0")).when(F.col(x) == F.col("x1"), F.col("y1")).otherwise(F.col("y0") + (F.col(x) - F.col("x0")) * F.col("slope"))
    return one.select("poly", F.col("from").alias("xa"), F.col("till").alias("xb"), y("from").alias("ya"), y("till").alias("yb"), "sign")


def shared(signed_a: DataFrame, signed_b: DataFrame, size: float, once: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, area_a, area_b, and so on for columns to ``carry``, intersection) of signed edges (``facing``, ``even_odd``) whose boxes meet."""

    def kernel(u: list[np.ndarray], v: list[np.ndarray]) -> tuple:
        (xa, xb, ya, yb, s), (pa_, pb, qa, qb, z) = ([c[:, :, None] for c in u], [c[:, None, :] for c in v])
        lo, hi = np.maximum(xa, pa_), np.minimum(xb, pb)
        wide = np.maximum(hi - lo, 0.0)
        m, n = ((d - c) / np.where(b > a, b - a, 1.0) for a, b, c, d in ((xa, xb, ya, yb), (pa_, pb, qa, qb)))
        q0 = qa + (lo - pa_) * n
        d0 = ya + (lo - xa) * m - q0
        d1 = d0 + wide * (m - n)
        below = np.minimum(d0, 0.0) + np.minimum(d1, 0.0)
        cut = (d0 < 0) != (d1 < 0)
        least = np.where(cut, -below * below / np.where(cut, np.abs(d1 - d0), 1.0), below)
        area = (s * z * wide * (q0 + wide * n / 2 + least / 2)).sum(axis=(1, 2))
        return slice(None), (area,)

    carry = ("area", *carry)
    sides = [e.withColumn("area", F.sum(F.expr("sign * (xb - xa) * (ya + yb) / 2")).over(W.partitionBy("poly"))) for e in (signed_a, signed_b)]
    found = met(*(gathered(e, SIGNED, "xa", "xb", carry) for e in sides), size, SIGNED, kernel, {"intersection": float}, once, carry)
    if large(signed_a) or large(signed_b):
        found = found.groupBy("a", "b").agg(F.sum("intersection").alias("intersection"), *(F.max(f"{c}_{k}").alias(f"{c}_{k}") for c in carry for k in "ab"))
    return found.select("a", "b", *(f"{c}_{k}" for c in carry for k in "ab"), "intersection")


def covered(spots: DataFrame, e: DataFrame, size: float) -> DataFrame:
    """(x, y, poly, boundary): polygons that hold a spot (x, y), the boundary included; an odd number of edges to the right is inside."""
    columns = ("x0", "y0", "x1", "y1")

    def rule(p: pa.Table, q: pa.Table) -> pa.Table:
        x, y = crowds.column(p, "x"), crowds.column(p, "y")
        l, m, r, t = (crowds.column(q, c) for c in BOX)
        u = _padded(q, columns)
        step = max(1, crowds.BLOCK // u[0].shape[1])
        found: list[tuple] = []
        for s in crowds.blocks(len(x), len(l)):
            i, j = np.nonzero((x[s, None] >= l) & (x[s, None] <= r) & (y[s, None] >= m) & (y[s, None] <= t))
            i += s.start
            for k in range(0, len(i), step):
                at, of = i[k : k + step], j[k : k + step]
                px, py = x[at][:, None], y[at][:, None]
                x0, y0, x1, y1 = (c[of] for c in u)
                real = (x0 != x1) | (y0 != y1)  # not what only fills a row
                side = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
                right = ((y0 > py) != (y1 > py)) & np.where(y1 > y0, side > 0, side < 0)
                on = real & (side == 0) & (px >= np.minimum(x0, x1)) & (px <= np.maximum(x0, x1)) & (py >= np.minimum(y0, y1)) & (py <= np.maximum(y0, y1))
                n, edge = right.sum(axis=1), on.any(axis=1)
                kept = slice(None) if many else np.flatnonzero((n % 2 == 1) | edge)
                found.append((at[kept], of[kept], n[kept], edge[kept]))
        at, of, n, edge = (np.concatenate([f[k] for f in found]) if found else np.empty(0, d) for k, d in enumerate((np.int64, np.int64, np.int64, bool)))
        return pa.table({"x": pa.array(x[at]), "y": pa.array(y[at]), "poly": q.column("id").take(pa.array(of)), "n": pa.array(n), "boundary": pa.array(edge)})

    many = large(e)
    a = spots.select("x", "y", crowds.tile("x", size).alias("tx"), crowds.tile("y", size).alias("ty"))
    out = crowds.met(a, tiled(gathered(e, columns, "x0", "x1"), size), ["tx", "ty"], rule, f"x double, y double, poly {dict(e.dtypes)['poly']}, n long, boundary boolean", MOST)
    if many:
        out = out.groupBy("x", "y", "poly").agg(F.sum("n").alias("n"), F.max("boundary").alias("boundary")).where("n % 2 = 1 OR boundary")
    return out.drop("n")
