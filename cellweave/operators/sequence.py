"""Ordered samples along a line: integration, crossings, runs, local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def section(samples: DataFrame, line: str, position: str, depth: str, threshold: float) -> DataFrame:
    """Trapezoid area, width at the threshold with linear crossings, longest deep run; a missing sample resets a run and withholds the whole."""
    w = W.partitionBy(line).orderBy(position)
    p = samples.withColumn("__p", F.lead(position).over(w)).withColumn("__d", F.lead(depth).over(w)).where("__p IS NOT NULL")
    d0, d1, length = F.col(depth), F.col("__d"), (F.col("__p") - F.col(position)).cast("double")
    both = d0.isNotNull() & d1.isNotNull()
    cross = F.try_divide(F.greatest(d0, d1) - threshold, F.greatest(d0, d1) - F.least(d0, d1))
    wide = F.when(both & (d0 >= threshold) & (d1 >= threshold), length).when(both & (F.greatest(d0, d1) >= threshold), length * cross).otherwise(0.0)
    deep = both & (d0 >= threshold) & (d1 >= threshold)
    p = p.select(line, F.col(position).alias("__at"), F.when(both, length * (d0 + d1) / 2).alias("__a"), wide.alias("__w"), F.when(deep, length).otherwise(0.0).alias("__r"), deep.alias("__k"), both.alias("__b"))
    p = p.withColumn("__run", F.sum(F.when(F.col("__k"), 0).otherwise(1)).over(W.partitionBy(line).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)))
    runs = p.groupBy(line, "__run").agg(F.sum("__r").alias("r")).groupBy(line).agg(F.max("r").alias("longest_run"))
    sums = p.groupBy(line).agg(F.sum("__a").alias("valid_area"), F.when(F.bool_and("__b"), F.sum("__a")).alias("area"), F.sum("__w").alias("deep_width"))
    return sums.join(runs, line)


def first_crossing(samples: DataFrame, line: str, position: str, depth: str, threshold: float) -> DataFrame:
    """(line, at, status): where depth first reaches the threshold, unless a missing sample comes before."""
    w = W.partitionBy(line).orderBy(position)
    prev_p, prev_d = F.lag(position).over(w), F.lag(depth).over(w)
    d = F.col(depth)
    at = F.when(d >= threshold, F.when(prev_d.isNull(), F.col(position).cast("double")).otherwise(prev_p + F.coalesce(F.try_divide(F.lit(threshold) - prev_d, d - prev_d), F.lit(0.0)) * (F.col(position) - prev_p)))
    marked = samples.select(line, F.col(position).alias("__p"), F.when(d.isNull(), F.col(position)).alias("__gap"), at.alias("__at"))
    out = marked.groupBy(line).agg(F.min("__gap").alias("gap"), F.min(F.when(F.col("__at").isNotNull(), F.struct("__p", "__at"))).alias("hit"))
    stopped = F.col("gap").isNotNull() & (F.col("hit").isNull() | (F.col("gap") < F.col("hit.__p")))
    return out.select(line, F.when(~stopped, F.col("hit.__at")).alias("at"), F.when(stopped, "stopped").when(F.col("hit").isNull(), "not_reached").otherwise("crossed").alias("status"))


def local_minima(sections: DataFrame, line: str, position: str, value: str, relief: float) -> DataFrame:
    """Inner places whose value is at least ``relief`` below both neighbours."""
    w = W.partitionBy(line).orderBy(position)
    v = F.col(value)
    return sections.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w)).where((F.col("__a") - v >= relief) & (F.col("__b") - v >= relief)).drop("__a", "__b")


def sinuosity(stations: DataFrame, line: str, position: str, x: str, y: str, spacing: float) -> DataFrame:
    """Mean of spacing over chord between neighbouring stations."""
    w = W.partitionBy(line).orderBy(position)
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    chord = stations.select(line, F.sqrt(dx * dx + dy * dy).alias("c"))
    return chord.where("c > 0").groupBy(line).agg(F.avg(F.lit(spacing) / F.col("c")).alias("sinuosity"))
