"""Dates as interval selection: annual, daily and composite periods, as-of rules, summaries of dated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def annual_label(year: str) -> Column:
    """January 1 of a year 1..9999, else null."""
    y = F.col(year)
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(1), F.lit(1)))


def overlaps(start: Column, end: Column, wanted_start: str, wanted_end: str) -> Column:
    """Half-open intervals that share time."""
    return (end > F.to_date(F.lit(wanted_start))) & (start < F.to_date(F.lit(wanted_end)))


def as_of(df: DataFrame, year: int, observed_end: str, available: str) -> DataFrame:
    """Records that were observed and available by a year; unknown years pass."""
    return df.where((F.col(observed_end).isNull() | (F.col(observed_end) <= year)) & (F.col(available).isNull() | (F.col(available) <= year)))


def evidence_summary(records: DataFrame, cell: str, year: str, present: str, reference: int, recent_years: int = 5) -> DataFrame:
    """Years, recency, persistence and latest state of a cell's dated evidence; in the latest year absence wins."""
    y, p = F.col(year), F.col(present)
    yes = F.when(p, y)
    out = records.groupBy(cell).agg(
        F.count_distinct(y).alias("surveyed_years"), F.count_distinct(yes).alias("observed_years"), F.min(yes).alias("first_year"), F.max(yes).alias("last_year"),
        F.max(F.struct(y.alias("y"), (~p).alias("a"))).alias("__t"), F.bool_or(~p).alias("__absent"),
    )
    recent = F.col("last_year").between(reference - recent_years + 1, reference)
    return out.select(
        cell, "surveyed_years", "observed_years", "first_year", "last_year", (F.lit(reference) - F.col("last_year")).alias("recency"), recent.alias("recent"),
        F.when(F.col("__absent"), F.col("observed_years") / F.col("surveyed_years")).alias("persistence"), F.when(F.col("__t.a"), "absent").otherwise("present").alias("latest_state"),
    )


def skeleton(cells: DataFrame, periods: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell in every period (the product is the delivered grain), with what was made for it, else nulls."""
    return cells.crossJoin(periods).join(made, keys, "left")
