"""Summaries of samples by cell, left-joined to the full support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ((0, 10), (10, 30), (30, 50), (50, 100), (100, 200), (200, None))
QUANTILES = (0.10, 0.25, 0.75, 0.90)


def depth(elevation: str) -> F.Column:
    """Positive depth of a marine sample; null on land or where not finite."""
    e = F.col(elevation)
    return F.when(~F.isnan(e) & (e < 0), -e)


def cell_summary(samples: DataFrame, support: DataFrame, cell: str, value: str, bands=BANDS, quantiles=QUANTILES) -> DataFrame:
    """Exact statistics of ``value`` by cell; cells of the support without samples keep nulls."""
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("range")]
    aggs.append(F.percentile(v, F.array(F.lit(0.5), *map(F.lit, quantiles))).alias("__q"))  # one exact value map for all of them
    inside = [(f"band_{lo}_{hi if hi is not None else 'up'}", (v >= lo) if hi is None else (v >= lo) & (v < hi)) for lo, hi in bands]
    aggs += [F.avg(F.when(v.isNotNull(), c.cast("double"))).alias(f"frac_{name}") for name, c in inside]
    made = samples.groupBy(cell).agg(*aggs).withColumns({"median": F.get("__q", F.lit(0))} | {f"q{round(q * 100):02d}": F.get("__q", F.lit(i)) for i, q in enumerate(quantiles, 1)}).drop("__q")
    return support.select(cell).join(made, cell, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def code_summary(samples: DataFrame, cell: str, code: str, codes: list, direct: list, has_value: str) -> DataFrame:
    """Counts by code among samples with a value, the direct share of the known, and a status."""
    ok = F.col(has_value).isNotNull()
    aggs = [F.count_if(ok).alias("n"), F.count_if(ok & F.col(code).isNotNull()).alias("known")] + [F.count_if(ok & (F.col(code) == c)).alias(f"n_{c}") for c in codes]
    out = samples.groupBy(cell).agg(*aggs, F.count_if(ok & F.col(code).isin(direct)).alias("n_direct"))
    status = F.when(F.col("n") == 0, "no_samples").when(F.col("known") == 0, "no_code").when(F.col("known") < F.col("n"), "partial").otherwise("complete")
    return out.select(cell, "n", "known", *(F.when(F.col("n") > 0, F.col(f"n_{c}")).alias(f"n_{c}") for c in codes), (F.col("n_direct") / F.nullif("known", F.lit(0))).alias("direct_frac"), status.alias("status"))


def coverage(samples: DataFrame, cell: str, elevation: str) -> DataFrame:
    """Expected, marine, land and missing sample counts by cell."""
    e = F.col(elevation)
    return samples.groupBy(cell).agg(F.count(F.lit(1)).alias("expected"), F.count_if(e < 0).alias("marine"), F.count_if(e >= 0).alias("land"), F.count_if(e.isNull()).alias("nodata"))


def class_shares(samples: DataFrame, group: list[str], label: str, labels: list[str]) -> DataFrame:
    """Share of each label among the rows of a group."""
    return samples.groupBy(*group).agg(*(F.avg((F.col(label).eqNullSafe(x)).cast("double")).alias(f"share_{x}") for x in labels))


def availability(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Long table (by, column, n_known, all_known): what is materialised."""
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.select(by, "n", F.expr(f"stack({len(columns)}, {pairs}) AS (column, n_known)")).select(by, "column", "n_known", (F.col("n_known") == F.col("n")).alias("all_known"))


def ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): the average rank of every distinct value.

    Values are counted first, so ties cost nothing; the counts are dealt by range
    and numbered within each range, and ranges are offset by their totals, one row each.
    """
    from pyspark.sql import Window as W

    from ..core import materialise

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, column)
    counts = materialise(counts.withColumn("part", F.spark_partition_id()))
    totals = counts.groupBy("part").agg(F.sum("n").alias("all"))
    before = totals.select("part", (F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("all")).alias("before"))  # a row a partition
    inside = F.sum("n").over(W.partitionBy("part").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("inside", inside).join(F.broadcast(before), "part")
    return placed.select(column, (F.col("before") + F.col("inside") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, min_overlap: int = 100) -> DataFrame:
    """Rank correlation with average ranks over complete pairs; null under the overlap."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = both.join(ranks(both, x).withColumnRenamed("rank", "rank_x"), x).join(ranks(both, y).withColumnRenamed("rank", "rank_y"), y)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= min_overlap, F.corr("rank_x", "rank_y")).alias("rho"))


def slope_summary(samples: DataFrame, cell: str, slope: str) -> DataFrame:
    """(cell, n, slope_mean, slope_q90): known pixel slopes by cell, the quantile exact."""
    return samples.groupBy(cell).agg(F.count(slope).alias("n"), F.avg(slope).alias("slope_mean"), F.percentile(slope, F.lit(0.9)).alias("slope_q90"))
