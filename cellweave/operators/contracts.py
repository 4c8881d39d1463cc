"""What the optimiser does not give: join cardinality, exact support, null rules, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks a declared rule."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes null; null is never zero."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def key_faults(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their row counts."""
    null_key = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | null_key)


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df`` itself, or an error that names five offending keys."""
    bad = key_faults(df, keys).limit(5).collect()
    if bad:
        raise ContractError(f"{what}: keys repeated or null: {[tuple(r)[:-1] for r in bad]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """Join with declared cardinality, one_to_one or many_to_one."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(validate)
    require_unique(right, on, "right side")
    if validate == "one_to_one":
        require_unique(left, on, "left side")
    return left.join(right, on, how)


def support_report(df: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys of the support that the table lacks, and keys it has beyond it."""
    a, b = df.select(*keys).distinct(), support.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def require_support(df: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    bad = support_report(df, support, keys).limit(5).collect()
    if bad:
        raise ContractError(f"support differs: {[tuple(r) for r in bad]}")
    return df


def align(df: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of the support, nulls where the table has none, in key order."""
    return support.select(*keys).join(df, keys, "left").orderBy(*keys)


def audit(df: DataFrame, keys: list[str], fractions: list[str] = (), finite: list[str] = ()) -> DataFrame:
    """One row of rule counts: rows, key faults, fractions out of [0, 1], non-finite values."""
    any_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    checks: list[Column] = [F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null).alias("n_null_keys"), (F.count_if(~any_null) - F.count_distinct(*keys)).alias("n_repeated")]
    checks += [F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"{c}_out") for c in fractions]
    checks += [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"{c}_nonfinite") for c in finite]
    return df.agg(*checks)


def key_hash(df: DataFrame, key: str) -> DataFrame:
    """sha256 of the sorted distinct keys, one a line; for key sets of delivery size."""
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\n"), 256).alias("key_hash"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: keys on either side only, and values that differ beyond the tolerance."""
    x, y = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("ina")), b.select(*keys, F.col(value).alias("y"), F.lit(1).alias("inb"))
    j = x.join(y, keys, "full")
    differ = (F.abs(F.col("x") - F.col("y")) > tolerance) | (F.col("x").isNull() != F.col("y").isNull())
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return j.agg(F.count_if(F.col("inb").isNull()).alias("only_left"), F.count_if(F.col("ina").isNull()).alias("only_right"), F.count_if(both & differ).alias("n_differ"))
