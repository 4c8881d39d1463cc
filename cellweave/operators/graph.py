"""Searches over weighted adjacency tables: relaxation by joins, lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialise


def mirrored(edges: DataFrame) -> DataFrame:
    """Directed edges (src, dst, w) from pairs stored once."""
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct()


def neighbourhoods(nodes: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(src, dst, hops, dist): least hops, then least distance among the ways of that many hops; with self at 0."""
    directed = materialise(mirrored(edges))
    frontier = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("dist"))
    found, before = frontier, None
    for h in range(1, max_hops + 1):
        step = frontier.select("src", F.col("dst").alias("via"), "dist").join(directed.select(F.col("src").alias("via"), F.col("dst"), "w"), "via")
        best = step.groupBy("src", "dst").agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        # ways go both ways, so a neighbour of this frontier is in it, in the one before, or new
        known = frontier.select("src", "dst") if before is None else frontier.select("src", "dst").union(before.select("src", "dst"))
        before, frontier = frontier, materialise(best.join(known, ["src", "dst"], "left_anti").select("src", "dst", F.lit(h).alias("hops"), "dist"))
        found = found.unionByName(frontier)
    return found


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Every node hooks to its smallest neighbour, pointer doubling leads each such tree to its root, and the edges between
    roots go on; trees at least halve where they meet, so rounds are logarithmic also for long chains.
    """
    own = nodes.select("node").distinct()
    left = mirrored(edges).select("src", "dst").where("src <> dst")
    for end in ("src", "dst"):
        left = left.join(own.select(F.col("node").alias(end)), end, "left_semi")
    left = materialise(left)
    labels = nodes.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        if left.isEmpty():
            return labels
        roots = materialise(left.groupBy(F.col("src").alias("at")).agg(F.least(F.col("src"), F.min("dst")).alias("to")))
        for _ in range(max_rounds):
            onward = roots.select(F.col("at").alias("to"), F.col("to").alias("next"))
            jumped = materialise(roots.join(onward, "to").select("at", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            roots = jumped.select("at", "to")
            if jumped.where("moved").isEmpty():
                break
        else:
            raise RuntimeError("components: no fixed point")
        labels = materialise(labels.join(roots, labels["component"] == roots["at"], "left").select("node", F.coalesce("to", "component").alias("component")))
        for end in ("src", "dst"):
            left = left.join(roots.select(F.col("at").alias(end), F.col("to").alias(f"{end}_root")), end)
        left = materialise(left.select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).where("src <> dst").distinct())
    raise RuntimeError("components: no fixed point")


def nearest_owner(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int | None = None, max_rounds: int = 500) -> DataFrame:
    """(node, dist, owner): distance to the nearest seed and its owner, of ties the smaller; null where none is in reach."""
    directed = materialise(mirrored(edges))
    best = materialise(seeds.groupBy("node").agg(F.min(F.struct(F.lit(0).cast("long").alias("dist"), F.col("owner"))).alias("b")))
    frontier = best
    for _ in range(max_rounds):
        step = frontier.join(directed, frontier["node"] == directed["src"]).select(F.col("dst").alias("node"), F.struct((F.col("b.dist") + F.col("w")).alias("dist"), F.col("b.owner").alias("owner")).alias("b"))
        if limit is not None:
            step = step.where(F.col("b.dist") <= limit)
        tried = step.groupBy("node").agg(F.min("b").alias("c"))
        frontier = materialise(tried.join(best, "node", "left").where(F.col("b").isNull() | (F.col("c") < F.col("b"))).select("node", F.col("c").alias("b")))
        if frontier.isEmpty():
            break
        best = materialise(best.join(frontier.select("node", F.col("b").alias("c")), "node", "full").select("node", F.coalesce("c", "b").alias("b")))
    else:
        raise RuntimeError("nearest_owner: no fixed point")
    return nodes.select("node").join(best, "node", "left").select("node", F.col("b.dist").alias("dist"), F.col("b.owner").alias("owner"))


def distances(edges: DataFrame, objects: DataFrame, limit: int, max_rounds: int = 500) -> DataFrame:
    """(object, node, dist): every node within ``limit`` of each object (columns object, node)."""
    return reached(materialise(mirrored(edges)), objects, limit, max_rounds)


def reached(directed: DataFrame, objects: DataFrame, limit: int, max_rounds: int = 500) -> DataFrame:
    """The same over edges that go one way (src, dst, w)."""
    best = materialise(objects.select("object", "node", F.lit(0).cast("long").alias("dist")).distinct())
    frontier = best
    for _ in range(max_rounds):
        step = frontier.join(directed, frontier["node"] == directed["src"]).select("object", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("new")).where(F.col("new") <= limit)
        tried = step.groupBy("object", "node").agg(F.min("new").alias("new"))
        frontier = materialise(tried.join(best, ["object", "node"], "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("object", "node", F.col("new").alias("dist")))
        if frontier.isEmpty():
            return best
        best = materialise(best.join(frontier.withColumnRenamed("dist", "new"), ["object", "node"], "full").select("object", "node", F.coalesce("new", "dist").alias("dist")))
    raise RuntimeError("distances: no fixed point")


def radius_sum(nodes: DataFrame, edges: DataFrame, values: DataFrame, limit: int) -> DataFrame:
    """(node, total): sum of eligible values within the radius; a node always counts itself, so a lone one keeps its own."""
    within = distances(edges, nodes.select(F.col("node").alias("object"), "node"), limit)
    return within.join(values, "node", "left").groupBy(F.col("object").alias("node")).agg(F.coalesce(F.sum(F.when(F.col("eligible"), F.col("value"))), F.lit(0)).alias("total"))


def relationships(nodes: DataFrame, objects: DataFrame, edges: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """(object, node, dist, status): one row for each pair. The product of cells and objects is the result itself."""
    pairs = nodes.select("node").crossJoin(objects.select("object", F.col("node").alias("at")))
    reach = distances(edges, objects, limit)
    a, b = parts.select("node", F.col("component").alias("__p")), parts.select(F.col("node").alias("at"), F.col("component").alias("__q"))
    status = F.when(F.col("dist").isNotNull(), "reachable").when(F.col("__p") != F.col("__q"), "disconnected").otherwise("search_limited")
    return pairs.join(reach, ["object", "node"], "left").join(a, "node").join(b, "at").select("object", "node", "dist", status.alias("status"))


def topology(tree: DataFrame, node: str, down: str) -> DataFrame:
    """(node, upstream, gap): direct upstream count and whether the downstream node is missing."""
    counts = tree.groupBy(F.col(down).alias("__n")).agg(F.count(F.lit(1)).alias("upstream"))
    known = tree.select(F.col(node).alias("__k"))
    joined = tree.join(counts, tree[node] == F.col("__n"), "left").join(known, tree[down] == F.col("__k"), "left")
    return joined.select(F.col(node).alias("node"), F.coalesce("upstream", F.lit(0)).alias("upstream"), (F.col(down).isNotNull() & F.col("__k").isNull()).alias("gap"))
