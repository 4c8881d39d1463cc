"""One-dimensional footprints: unions counted once, overlays, lengths by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merged(records: DataFrame, keys: list[str], x0: str, x1: str) -> DataFrame:
    """(keys, start, end): maximal unions of the records' intervals."""
    order = W.partitionBy(*keys).orderBy(x0, x1)
    reach = F.max(x1).over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = records.where(F.col(x1) > F.col(x0)).withColumn("__new", F.when(reach.isNull() | (F.col(x0) > reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(x0).alias("start"), F.max(x1).alias("end")).drop("__island")


def union_length(records: DataFrame, keys: list[str], x0: str, x1: str, name: str = "length") -> DataFrame:
    """Length of the union by key: overlaps count once."""
    return merged(records, keys, x0, x1).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def pieces(records: DataFrame, keys: list[str], x0: str, x1: str) -> DataFrame:
    """(keys, start, end): elementary pieces between neighbouring end points."""
    ends = records.select(*keys, F.explode(F.array(x0, x1)).alias("start")).distinct()
    return ends.withColumn("end", F.lead("start").over(W.partitionBy(*keys).orderBy("start"))).where("end IS NOT NULL")


def overlay(records: DataFrame, keys: list[str], x0: str, x1: str, rank: list[Column], value: str) -> DataFrame:
    """(keys, start, end, value): on every elementary piece the covering record of the highest rank decides.

    Records of a key that share rank and value are united first, so a crowded key
    costs its pieces times its different ranks, not times its records.
    """
    ranked = records.select(*keys, x0, x1, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(value).alias("value")).alias("__top"))
    united = merged(ranked, [*keys, "__top"], x0, x1)
    covering = united.select(*keys, F.col("start").alias("__a"), F.col("end").alias("__b"), "__top")
    hit = pieces(united, keys, "start", "end").join(covering, keys).where((F.col("__a") <= F.col("start")) & (F.col("__b") >= F.col("end")))
    return hit.groupBy(*keys, "start", "end").agg(F.max("__top").alias("t")).select(*keys, "start", "end", F.col("t.value").alias("value"))


def latest_evidence(records: DataFrame, keys: list[str], x0: str, x1: str, year: str, priority: str, absent: str) -> DataFrame:
    """Lengths where the latest evidence says present or absent; at equal year and priority absence wins."""
    top = overlay(records, keys, x0, x1, [F.col(year), F.col(priority), F.col(absent).cast("int")], absent)
    length = F.col("end") - F.col("start")
    return top.groupBy(*keys).agg(F.sum(F.when(~F.col("value"), length).otherwise(0)).alias("present_len"), F.sum(F.when(F.col("value"), length).otherwise(0)).alias("absent_len"))


def claimed_fraction(records: DataFrame, keys: list[str], x0: str, x1: str, fraction: str) -> DataFrame:
    """Length-weighted fraction where, on overlaps, the larger fraction claims the piece.

    Records without a finite fraction supply no length; one outside 0..1 is an error.
    """
    f = F.col(fraction)
    known = records.where(f.isNotNull() & ~F.isnan(f.cast("double")))
    known = known.where(F.assert_true(f.between(0, 1), F.lit("fractions must lie in [0, 1]")).isNull())
    top = overlay(known, keys, x0, x1, [f], fraction)
    length = (F.col("end") - F.col("start")).cast("double")
    return top.groupBy(*keys).agg(F.sum(length * F.col("value")).alias("weighted_len"), F.sum(length).alias("surveyed_len")).withColumn("fraction", F.col("weighted_len") / F.col("surveyed_len"))


def class_lengths(records: DataFrame, key: str, x0: str, x1: str, label: str, labels: list[str]) -> DataFrame:
    """Mapped length, length of each class, and the length on which classes overlap."""
    total = union_length(records, [key], x0, x1, "mapped_len")
    by_class = union_length(records, [key, label], x0, x1, "class_len").groupBy(key).agg(*(F.sum(F.when(F.col(label) == c, F.col("class_len"))).alias(f"len_{c}") for c in labels), F.sum("class_len").alias("__all"))
    return total.join(by_class, key).withColumn("overlap_len", F.col("__all") - F.col("mapped_len")).drop("__all")


def areal_shares(records: DataFrame, key: str, x0: str, x1: str, label: str, labels: list[str], slack: float = 1.0) -> DataFrame:
    """Class shares of the mapped union, withheld where classes overlap by more than the slack."""
    c = class_lengths(records, key, x0, x1, label, labels)
    clash = F.col("overlap_len") > F.greatest(F.lit(slack), F.col("mapped_len") * 1e-8)
    return c.select(key, "mapped_len", clash.alias("withheld"), *(F.when(~clash, F.coalesce(F.col(f"len_{x}") / F.col("mapped_len"), F.lit(0.0))).alias(f"share_{x}") for x in labels))
