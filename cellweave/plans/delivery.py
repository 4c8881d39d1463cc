"""Assembly and delivery: aligned products, public projections, history, manifests."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import ContractError, require_support, require_unique


def prefixed(df: DataFrame, product: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{product}__{c}") for c in df.columns if c not in keys))


def assemble(support: DataFrame, products: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All products on the support's keys: each must have unique keys and exactly that support."""
    checked = [prefixed(require_support(require_unique(df, keys, name), support, keys), name, keys) for name, df in products.items()]
    return reduce(lambda a, b: a.join(b, keys), checked, support.select(*keys)).orderBy(*keys)


#: Words of a column's name, between underscores or at its ends, that make it a diagnostic and no metric.
DIAGNOSTIC_WORDS = (
    "COVERAGE", "CENSORED", "AUDIT", "QC", "STATUS", "PROVENANCE", "SOURCE", "METHOD", "CONFIDENCE", "UNMAPPED", "CONNECTOR", "HIERARCHY", "DISCONTINUITY", "COUNT_VALID", "VALID_COUNT", "SAMPLE_COUNT",
    "OBSERVATION_YEAR", "OBSERVATION_DATE", "PIXEL_COUNT", "EVIDENCE_INCLUDED", "GEOMETRY_INCLUDED", "RECORD_COUNT", "LATEST_SURVEY_YEAR", "LATEST_ASSESSMENT_YEAR", "YEARS_SURVEYED", "YEARS_OBSERVED",
    "FIRST_YEAR", "LAST_YEAR", "RECENCY_YEARS", "VALID_NEIGHBOR", "ASSESSED_SITE_COUNT",
)
DIAGNOSTIC = re.compile(rf"(?:^|_)(?:{'|'.join(DIAGNOSTIC_WORDS)})(?:_|$)", re.IGNORECASE)


def public_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and numeric metrics; booleans become 0 or 1, nulls stay."""
    out = []
    for f in df.schema.fields:
        if f.name in keys:
            out.append(F.col(f.name))
        elif DIAGNOSTIC.search(f.name):
            continue
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.col(f.name))
    return df.select(*out)


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Public booleans: unknown counts as false, the original stays beside it."""
    return df.withColumns({f"{c}_SOURCE_NULLABLE": F.col(c) for c in columns}).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in columns})


def appended(base: DataFrame, extra: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Columns of an equally keyed table beside the base's; the base must come back unchanged."""
    out = base.join(prefixed(require_support(require_unique(extra, keys), base, keys), name, keys), keys)
    if not out.select(*base.columns).exceptAll(base).isEmpty():
        raise ContractError("the base changed")
    return out


def eligible(df: DataFrame, rules: list[tuple[str, str]], column: str) -> DataFrame:
    """``exclusion``: the first rule (name, SQL condition) that a catalog row meets, else null."""
    return df.withColumn("exclusion", F.coalesce(*(F.when(F.expr(cond), F.lit(name)) for name, cond in rules)))


def pivoted(long: DataFrame, keys: list[str], name: str, value: str, chosen: list[str], prefix: str) -> DataFrame:
    """Wide columns for the chosen objects only."""
    wide = long.groupBy(*keys).pivot(name, chosen).agg(F.first(value))
    return wide.select(*keys, *(F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in chosen))


def manifest(df: DataFrame, sources: list[str]) -> dict:
    """Schema, row count, null rates and a hash of it all."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns)).first()
    out = {"schema": json.loads(df.schema.json()), "rows": row["__n"], "null_rates": {c: row[c] for c in df.columns}, "sources": sorted(sources)}
    return out | {"hash": hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()}


def feature_catalog(df: DataFrame, keys: list[str]) -> DataFrame:
    """(name, type, label, unit, known_share): one row a column that is no key; the shares come from one pass."""
    from ..operators import labels

    others = [f for f in df.schema.fields if f.name not in keys]
    kinds = F.create_map(*(F.lit(x) for f in others for x in (f.name, f.dataType.simpleString())))
    shares = df.agg(*(F.avg(F.col(f.name).isNotNull().cast("double")).alias(f.name) for f in others))
    long = shares.select(F.explode(F.create_map(*(x for f in others for x in (F.lit(f.name), F.col(f.name))))).alias("name", "known_share"))
    return long.select("name", F.element_at(kinds, F.col("name")).alias("type"), labels.human_label(F.col("name")).alias("label"), labels.unit_of(F.col("name")).alias("unit"), "known_share")
