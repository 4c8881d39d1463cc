"""Connected components over an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TASK_ROWS, compact, materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node key that can be reached.

    ``edges`` has columns a, b. Each round takes the smallest label of the
    neighbours and then moves every label to the best one that any of its nodes
    has seen, so that chains shorten by more than half a round. All steps are
    sums before the shuffle or joins that may be split; each round is written to
    the shared checkpoint folder.
    """
    both = compact(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    parts = both.count() // TASK_ROWS + 1
    labels = materialise(both.select(F.col("u").alias("node")).distinct().coalesce(parts).withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")).coalesce(parts)
        seen = labels.join(near, "node", "left").withColumn("best", F.least("label", F.coalesce("near", "label"))).coalesce(parts)
        moved = seen.groupBy("label").agg(F.min("best").alias("to")).coalesce(parts)
        after = materialise(seen.join(moved, "label").select("node", F.least("best", "to").alias("label"), (F.least("best", "to") != F.col("label")).alias("changed")).coalesce(parts))
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels
    raise RuntimeError("components: no fixed point")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only the components that these join are searched, not their nodes."""
    left, right = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    named = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    between = compact(named.where("a <> b").distinct())
    if between.isEmpty():
        return labels
    moved = components(between).select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = moved.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return compact(known.union(fresh))
