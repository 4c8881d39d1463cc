"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows whose crc32 of the id, as text, leaves this remainder by three are never learnt from.
HELD_OUT = 1


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the rows kept for measuring; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, grade: F.Column, grades: range, per_grade: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, grade): at most ``per_grade`` rows a grade, whole texts of up to ``max_chars`` characters.

    Ids are drawn from the labels alone, in hash order, so the texts are read
    once against a table of bounded size. Labelled rows without a text, and
    rows of several labels, are settled here: the lowest grade counts.
    """
    ids = labels.select(F.col(doc_id).alias("__cw_id"), grade.cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col("__cw_id").isNotNull() & ~held_out("__cw_id")).groupBy("__cw_id").agg(F.min("grade").alias("grade"))
    drawn = reduce(DataFrame.union, [ids.where(F.col("grade") == g).orderBy(F.xxhash64("__cw_id"), "__cw_id").limit(per_grade) for g in grades])
    # the draw holds at most per_grade * len(grades) ids
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("__cw_id"))
    once = found.where(F.length("text") <= max_chars).withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("text"))).where("n = 1")
    return once.select("id", "text", "grade").orderBy("id").select("text", "grade")
