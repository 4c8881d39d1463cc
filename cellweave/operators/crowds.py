"""Rows of two tables that meet by key, worked off as Arrow tables: for joins whose pairs are too many to be made one by one.

Every key's left rows are dealt to parts of bounded size, each met by all of the key's right rows, so a crowded
key is spread over tasks. Both sides go to a fixed number of partitions: small tables whose pairs are
many would otherwise be coalesced into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a block of pairs: its arrays stay in a core's cache.
BLOCK = 1 << 16


def width(df: DataFrame) -> int:
    """Partitions for a join whose pairs outnumber its rows by far."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def met(left: DataFrame, right: DataFrame, keys: list[str], rule: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most: int = 4096) -> DataFrame:
    """``rule`` of every part of a key's left rows and all of its right rows; keys without left rows are left out."""
    n = width(left)
    parts = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("__parts"))
    own = [c for c in left.columns if c not in keys]
    a = left.join(parts, keys).withColumn("__part", F.pmod(F.xxhash64(*own), "__parts")).drop("__parts")
    b = right.select(*(F.col(c).alias(c) for c in right.columns)).join(parts, keys).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    at = [*keys, "__part"]
    return a.repartition(n, *at).groupBy(*at).cogroup(b.repartition(n, *at).groupBy(*at)).applyInArrow(rule, schema)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def blocks(rows: int, others: int) -> Iterator[slice]:
    """Slices of the rows whose product with the others is a block."""
    step = max(1, BLOCK // max(1, others))
    return (slice(i, i + step) for i in range(0, rows, step))


def tile(c: str, size: float | Column) -> Column:
    return F.floor(F.col(c) / size)


def near_tiles(df: DataFrame, limit: float, size: float) -> DataFrame:
    """``df`` with a row for every tile (tx, ty) that some point within the limit of (x, y) may lie in."""
    k = int(-(-limit // size))
    out = df.withColumn("tx", F.explode(F.sequence(tile("x", size) - k, tile("x", size) + k))).withColumn("ty", F.explode(F.sequence(tile("y", size) - k, tile("y", size) + k)))
    off = lambda c, t: F.greatest(F.col(t) * size - F.col(c), F.col(c) - (F.col(t) + 1) * size, F.lit(0.0))
    return out.where(F.hypot(off("x", "tx"), off("y", "ty")) <= limit * (1 + 1e-9))
