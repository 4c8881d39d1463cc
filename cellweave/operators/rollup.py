"""Child-to-parent rollups: the function is chosen per column, in one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def weighted_mean(value: str | Column, weight: str | Column, need_all: bool = False) -> Column:
    """Mean over rows with a value and a positive weight; null if there is none (or, with need_all, if any value is unknown)."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    ok = v.isNotNull() & (w > 0)
    mean = F.sum(F.when(ok, v * w)) / F.sum(F.when(ok, w))
    return F.when(F.count(v) == F.count(F.lit(1)), mean) if need_all else mean


def tokens(column: str, separator: str = "|") -> Column:
    """Sorted distinct tokens of delimited sets, joined again; null if there is none."""
    parts = F.array_distinct(F.flatten(F.collect_set(F.split(F.col(column), r"\|"))))
    clean = F.array_sort(F.filter(F.transform(parts, F.trim), lambda x: x != ""))
    return F.when(F.size(clean) > 0, F.array_join(clean, separator))


def parent_rollup(children: DataFrame, parent: str, spec: dict[str, str], weight: str) -> DataFrame:
    """One row a parent. Kinds: sum, min, max, wmean_any, wmean_all, any, all, union, count."""
    kinds = {
        "sum": lambda c: F.sum(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "wmean_any": lambda c: weighted_mean(c, weight),
        "wmean_all": lambda c: weighted_mean(c, weight, True),
        "any": lambda c: F.bool_or(c),
        "all": lambda c: F.bool_and(c),
        "union": lambda c: tokens(c),
        "count": lambda c: F.count(c),
    }
    return children.groupBy(parent).agg(*(kinds[kind](c).alias(c if "__" not in c else c) for c, kind in spec.items()))


def best_child(children: DataFrame, parent: str, order: list[Column], id_column: str) -> DataFrame:
    """The row of each parent's first child in the order (nulls last), ties by id."""
    w = W.partitionBy(parent).orderBy(*[o.asc_nulls_last() for o in order], F.col(id_column))
    return children.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def best_dataset(estimates: DataFrame, group: list[str], dataset: str, weighted: str, surveyed: str) -> DataFrame:
    """Sum estimates by data set, then the data set of the largest share; of ties the larger name."""
    summed = estimates.groupBy(*group, dataset).agg(F.sum(weighted).alias("w"), F.sum(surveyed).alias("s"))
    share = summed.withColumn("share", F.when(F.col("s") > 0, F.col("w") / F.col("s")))
    return share.where("share IS NOT NULL").groupBy(*group).agg(F.max(F.struct(F.round("share", 9).alias("share"), F.col(dataset).alias("dataset"), "w", "s")).alias("m")).select(*group, F.col("m.share").alias("share"), F.col("m.dataset").alias("dataset"))


def observation_state(present: str, absent: str, area: str, tolerance: float = 1e-9) -> Column:
    """Parent state from observed areas."""
    p, a, t = F.col(present), F.col(absent), F.col(area)
    return (
        F.when((p > tolerance) & (a > tolerance), "mixed_partial")
        .when(p > t - tolerance, "present")
        .when(p > tolerance, "partial_present")
        .when(a > t - tolerance, "absent")
        .when(a > tolerance, "partial_absent")
        .otherwise("unknown")
    )


def persistence(children: DataFrame, parent: str, ratio: str, basis: str, years: str) -> DataFrame:
    """Years-weighted ratio where one basis covers the children, else null with the joined bases."""
    one = F.count_distinct(basis) == 1
    return children.groupBy(parent).agg(F.when(one, weighted_mean(ratio, years)).alias("persistence"), F.array_join(F.array_sort(F.collect_set(basis)), "|").alias("basis"))


def entropy(parts: list[str], tolerance: float = 1e-3) -> Column:
    """Normalised entropy of fractions that are all known and close to one."""
    known = reduce(lambda a, b: a & b, (F.col(p).isNotNull() for p in parts))
    total = reduce(lambda a, b: a + b, (F.col(p) for p in parts))
    terms = reduce(lambda a, b: a + b, (F.when(F.col(p) > 0, F.col(p) * F.ln(F.col(p))).otherwise(0.0) for p in parts))
    return F.when(known & (F.abs(total - 1) <= tolerance), -terms / F.ln(F.lit(float(len(parts)))))


def available_score(scores: dict[str, float], required: str) -> Column:
    """Weights renormalised over the known scores; null without the required one."""
    num = reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in scores.items()))
    den = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in scores.items()))
    return F.when(F.col(required).isNotNull() & (den > 0), num / den)
