"""Shortest ways with their nodes: a search leaves predecessors, doubling lists the ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialise
from . import graph


def water_steps(wet: DataFrame, stride: int, size: int) -> DataFrame:
    """(src, dst, w) of steps between wet pixels (row, col, clearance); a node is row * stride + col.

    Steps go to the eight neighbours, a slanted one only between pixels whose common neighbours are both
    wet. A step costs its length times 1 + size / clearance where it leads, in thousandths rounded to
    whole ones, so ways keep to the middle of the water; ``size`` is a pixel's side, the least clearance.
    """
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    node = lambda r, c: F.col(r) * stride + F.col(c)
    cost = F.round((1 + size / F.greatest("clearance", F.lit(size))) * size * 1000 * F.sqrt(F.abs("dr") + F.abs("dc"))).cast("long")
    to = wet.select("row", "col", "clearance", F.inline(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in around))))
    to = to.select((F.col("row") - F.col("dr")).alias("r"), (F.col("col") - F.col("dc")).alias("c"), "row", "col", "dr", "dc", cost.alias("w"))
    at = wet.select(F.col("row").alias("r"), F.col("col").alias("c"))
    steps = to.join(at, ["r", "c"])
    # the two pixels beside a slanted step
    for name, r, c in (("a", "r", "col"), ("b", "row", "c")):
        beside = wet.select(F.col("row").alias(f"{name}r"), F.col("col").alias(f"{name}c"))
        steps = steps.join(beside, (F.col(r) == F.col(f"{name}r")) & (F.col(c) == F.col(f"{name}c")), "left_semi")
    return steps.select(node("r", "c").alias("src"), node("row", "col").alias("dst"), "w")


def shortest(edges: DataFrame, legs: DataFrame, limit: int, max_rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """Ways of least weight over one-way edges (src, dst, w > 0) for legs (leg, src, dst), none longer than ``limit``.

    First (leg, step, node, dist), dist from the leg's start; second (leg, length, hops, status), status reachable or
    no_path_within_limit. Of ways of one length the one wins whose last nodes are smallest, seen from its end.
    Legs from one start share their search. Legs from a node to itself have that one node.
    """
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(F.raise_error(F.lit("shortest: weights must be above 0")).cast("long"))
    steps = materialise(edges.groupBy("src", "dst").agg(F.min(w).alias("w")))
    legs = materialise(legs.select("leg", F.col("src").alias("object"), F.col("dst").alias("node")))
    reach = graph.reached(steps, legs.select("object", F.col("object").alias("node")).distinct(), limit, max_rounds)
    ends = materialise(legs.join(reach, ["object", "node"], "left"))
    far = ends.groupBy("object").agg(F.max("dist").alias("far"))
    kept = materialise(reach.join(far, "object").where("dist <= far").drop("far"))
    before = kept.select("object", F.col("node").alias("src"), F.col("dist").alias("d0"))
    last = before.join(steps, "src").select("object", F.col("dst").alias("node"), F.col("src").alias("to"), (F.col("d0") + F.col("w")).alias("dist"))
    jump = materialise(last.join(kept, ["object", "node", "dist"]).groupBy("object", "node").agg(F.min("to").alias("to")))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select("object", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = materialise(jump.join(onward, ["object", "to"]).select("object", "node", F.col("next").alias("to")))
    at = ends.where("dist IS NOT NULL").select("leg", "object", "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        moved = at.join(jumps[k], ["object", "node"]).select("leg", "object", F.col("to").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        at = materialise(at.unionByName(moved))
    hops = at.groupBy("leg").agg(F.max("back").alias("hops"))
    ways = at.join(hops, "leg").join(kept, ["object", "node"]).select("leg", (F.col("hops") - F.col("back")).alias("step"), "node", "dist")
    status = F.when(F.col("dist").isNull(), "no_path_within_limit").otherwise("reachable")
    return ways, ends.join(hops, "leg", "left").select("leg", F.col("dist").alias("length"), "hops", status.alias("status"))


def legs_of_routes(anchors: DataFrame) -> DataFrame:
    """(leg, src, dst): a leg (route, no) between neighbouring anchors (route, seq, node) in the order of ``seq``."""
    from pyspark.sql import Window as W

    w = W.partitionBy("route").orderBy("seq", "node")
    after = anchors.select("route", "node", F.lead("node").over(w).alias("dst"), (F.row_number().over(w) - 1).alias("no"))
    return after.where("dst IS NOT NULL").select(F.struct("route", "no").alias("leg"), F.col("node").alias("src"), "dst")


def routes(anchors: DataFrame, edges: DataFrame, limit: int, max_rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """Whole routes through ordered anchors: (route, step, node, dist), and (route, length, status).

    Where legs meet, the anchor stands once. Statuses: found, leg_without_path (no rows then), repeated_node (the
    route comes back to a node; its rows are given). Routes of one anchor have no legs and no rows.
    """
    ways, summary = shortest(edges, legs_of_routes(anchors), limit, max_rounds)
    ends = summary.select("leg.route", "leg.no", "length", "hops")
    each = ends.groupBy("route").agg(F.when(F.count("length") == F.count(F.lit(1)), F.sum("length")).alias("length"))
    # what the legs before have walked: legs of a route are few beside its nodes
    earlier = ends.alias("a").join(ends.alias("b"), (F.col("a.route") == F.col("b.route")) & (F.col("b.no") < F.col("a.no")), "left")
    earlier = earlier.groupBy(F.col("a.route").alias("route"), F.col("a.no").alias("no")).agg(F.coalesce(F.sum("b.hops"), F.lit(0)).alias("steps"), F.coalesce(F.sum("b.length"), F.lit(0)).alias("base"))
    whole = ways.select("leg.route", "leg.no", "step", "node", "dist").join(each.where("length IS NOT NULL").select("route"), "route", "left_semi")
    whole = whole.where("no = 0 OR step > 0").join(earlier, ["route", "no"]).select("route", (F.col("step") + F.col("steps")).alias("step"), "node", (F.col("dist") + F.col("base")).alias("dist"))
    again = whole.groupBy("route", "node").count().where("count > 1").select("route").distinct().withColumn("again", F.lit(True))
    status = F.when(F.col("length").isNull(), "leg_without_path").when(F.col("again"), "repeated_node").otherwise("found")
    return whole, each.join(again, "route", "left").select("route", "length", status.alias("status"))
