"""Statistics of hop-bounded windows: a neighbourhood table joined with node values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def windows(hood: DataFrame, values: DataFrame, max_hops: int, with_self: bool = False) -> DataFrame:
    """(src, hops, z, focal, ...): values of the neighbours beside that of the source."""
    near = hood.where((F.col("hops") <= max_hops) & (F.col("hops") >= (0 if with_self else 1)))
    own = values.select(F.col("node").alias("src"), F.col("z").alias("focal"))
    return near.join(values.withColumnRenamed("node", "dst"), "dst").join(own, "src")


def anomaly(hood: DataFrame, values: DataFrame, max_hops: int) -> DataFrame:
    """(node, anomaly): the focal value less the mean of its neighbours."""
    return windows(hood, values, max_hops).groupBy(F.col("src").alias("node")).agg((F.first("focal") - F.avg("z")).alias("anomaly"))


def ring_statistics(hood: DataFrame, values: DataFrame, max_hops: int) -> DataFrame:
    """Position, spread and relief of the window, the focal node included in the spread."""
    w = windows(hood, values, max_hops, True)
    other = F.col("hops") > 0
    first = w.groupBy("src").agg(
        F.first("focal").alias("focal"), F.count_if(other).alias("n"), (F.avg(F.when(other, F.col("z"))) - F.first("focal")).alias("tpi"), F.stddev_pop("z").alias("std"), (F.max("z") - F.min("z")).alias("range"),
        F.max(F.abs(F.col("z") - F.col("focal"))).alias("relief"), F.median("z").alias("middle"), F.avg(F.when(other, F.abs(F.col("z") - F.col("focal")))).alias("ruggedness"),
    )
    mad = w.select("src", "z").join(first.select("src", "middle"), "src").groupBy("src").agg(F.median(F.abs(F.col("z") - F.col("middle"))).alias("mad"))
    z = F.when(F.col("std") > 1e-9, F.col("tpi") / F.col("std")).when(F.abs("tpi") <= 1e-9, 0.0)
    return first.join(mad, "src").select(F.col("src").alias("node"), "n", "tpi", z.alias("tpi_z"), "std", "range", "relief", "ruggedness", "mad")


def plane(hood: DataFrame, values: DataFrame, max_hops: int, minimum: int = 3) -> DataFrame:
    """Least-squares slope and aspect in degrees from centred sums; ``values`` has node, z, x, y."""
    w = windows(hood, values, max_hops, True)
    mean = F.avg
    over = W.partitionBy("src")
    c = w.select("src", *((F.col(v) - mean(v).over(over)).alias(v) for v in "xyz"))
    s = c.groupBy("src").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy", "xz", "yz")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = (F.col("n") > minimum) & (det > 1e-12)
    s = s.withColumn("gx", F.when(ok, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det)).withColumn("gy", F.when(ok, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det))
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    turn = F.degrees(F.atan2("gx", "gy"))
    return s.select(F.col("src").alias("node"), F.degrees(F.atan(size)).alias("slope"), F.when(size > 1e-12, F.when(turn < 0, turn + 360).otherwise(turn)).alias("aspect"), "gx", "gy")


def majority_relabel(labels: DataFrame, edges: DataFrame, sizes: DataFrame, minimum: int) -> DataFrame:
    """One synchronous pass: nodes of components under the minimum take their neighbours' most frequent other label, of ties the smaller."""
    small = labels.join(sizes, "node").where(F.col("size") < minimum).select("node", "label")
    around = small.join(edges, small["node"] == edges["src"]).select("node", "label", "dst").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("near")), "dst").where(F.col("near") != F.col("label"))
    votes = around.groupBy("node", "near").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("near")).alias("o"))).alias("m")).select("node", (-F.col("m.o")).alias("to"))
    return labels.join(won, "node", "left").select("node", F.coalesce("to", "label").alias("label"))


def minimum_mapping_unit(labels: DataFrame, edges: DataFrame, scores: DataFrame, minimum: int, passes: int = 3) -> DataFrame:
    """(node, label) after up to ``passes`` synchronous passes: nodes of same-label components under the minimum take a neighbour's label.

    Only labels with a positive score of the node's own (node, label, score) count;
    the most frequent among the neighbours wins, of ties the one of the highest own
    score, then the smaller label. Component sizes are found anew before each pass.
    """
    from ..core import materialise
    from . import graph

    arcs = materialise(graph.mirrored(edges).select("src", "dst", "w"))
    now = materialise(labels.select("node", "label"))
    for _ in range(passes):
        a, b = now.select(F.col("node").alias("src"), F.col("label").alias("la")), now.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
        named = materialise(arcs.join(a, "src").join(b, "dst"))
        parts = graph.components(now.select("node"), named.where("la = lb").select("src", "dst", "w"))
        small = parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").where(F.col("size") < minimum).select(F.col("node").alias("src"))
        votes = named.where("la <> lb").join(small, "src", "left_semi").groupBy(F.col("src").alias("node"), F.col("lb").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        order = W.partitionBy("node").orderBy(F.desc("n"), F.desc("score"), "label")
        won = materialise(votes.join(scores.where("score > 0"), ["node", "label"]).withColumn("k", F.row_number().over(order)).where("k = 1").select("node", F.col("label").alias("to")))
        if won.isEmpty():
            break
        now = materialise(now.join(won, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
    return now
