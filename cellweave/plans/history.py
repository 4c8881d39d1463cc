"""Selections of dated tables by requested interval, with a coverage report, and audits before release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts


def select_history(table: DataFrame, start: str, end: str, precision: str = "daily", days: int = 1, years: list[int] | None = None) -> DataFrame:
    """Rows of a dated table whose period touches [start, end): a year, a day, or a composite of ``days``."""
    begin = F.col("date") if precision != "annual" else F.trunc("date", "year")
    finish = F.add_months(begin, 12) if precision == "annual" else F.date_add(begin, days if precision == "composite" else 1)
    out = table.where((finish > F.to_date(F.lit(start))) & (begin < F.to_date(F.lit(end))))
    return out if years is None else out.where(F.year("date").isin(years))


def coverage(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(area, periods, rows, first, last, cells): what each selection holds."""
    parts = [df.agg(F.lit(name).alias("area"), F.count_distinct("date").alias("periods"), F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct(*keys).alias("cells")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def release_audit(tables: dict[str, DataFrame], support: DataFrame, keys: list[str], fractions: dict[str, list[str]] | None = None) -> DataFrame:
    """(product, rule, n): rules that products break; nothing may be promoted while this has rows."""
    out = []
    for name, df in tables.items():
        faults = [("repeated_or_null_key", contracts.key_faults(df, keys)), ("support", contracts.support_report(df, support, keys))]
        faults += [(f"fraction_{c}", df.where((F.col(c) < 0) | (F.col(c) > 1))) for c in (fractions or {}).get(name, [])]
        numeric = [c for c, t in df.dtypes if t in ("double", "float")]
        faults += [(f"nonfinite_{c}", df.where(F.isnan(c) | (F.abs(c) == float("inf")))) for c in numeric]
        out += [bad.agg(F.lit(name).alias("product"), F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")) for rule, bad in faults]
    return reduce(DataFrame.unionByName, out).where("n > 0")


def normalised(source: DataFrame, columns: dict[str, str], fixed: dict[str, object], schema: list[tuple[str, str]]) -> DataFrame:
    """A source's records in the common schema: SQL expressions by target column, fixed values, null for the rest."""
    made = {**{k: F.expr(v) for k, v in columns.items()}, **{k: F.lit(v) for k, v in fixed.items()}}
    unknown = set(made) - {n for n, _ in schema}
    if unknown:
        raise contracts.ContractError(f"not in the schema: {sorted(unknown)}")
    return source.select(*(made.get(n, F.lit(None)).cast(t).alias(n) for n, t in schema))
