"""Queries and SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format,
    collocations,
    decontaminate,
    mixing,
    near_dedup,
    ordinal_quality,
    page_text,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    turn_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chat_format.op1_chat_format,
        mixing.op2_pfair_mixing,
        toxicity.op3_toxicity,
        near_dedup.op4_minhash_near_dedup,
        suffix_dedup.op5_suffix_dedup,
        substring_dedup.op6_substring_dedup,
        token_counts.op7_token_counts,
        decontaminate.op8_benchmark_decontamination,
        quality_rules.op9_quality_rules,
        ordinal_quality.op10_ordinal_quality,
        turn_repair.op11_turn_repair,
        collocations.op12_collocations,
        page_text.op13_html_extraction,
    )
}

ORACLES: dict[str, str] = {
    "op2_pfair_mixing": mixing.SQL,
    "op4_minhash_near_dedup": near_dedup.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op12_collocations": collocations.SQL,
}
