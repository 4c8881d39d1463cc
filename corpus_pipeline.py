"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

Every stage reads what its predecessor wrote and takes effect on the rows; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import decontaminate, mixing, near_dedup, quality_rules, substring_dedup
from cellweave.llm.common import written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pfair_mixing", mixing.stage),
]

#: SQL has no counterpart of the stages as a whole; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
