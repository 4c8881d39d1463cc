"""Rewriting the few texts that have removals, without shuffling the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise, small_batches

#: Bits of the filter: 16 a wanted id, between these bounds (2 MB at most).
BITS = (1 << 16, 1 << 24)


def id_filter(ids: DataFrame, column: str = "id") -> tuple[int, np.ndarray]:
    """A one-hash filter of bounded size over long ids: no false negatives."""
    n, m = ids.count(), BITS[0]
    while m < 16 * n and m < BITS[1]:
        m *= 2
    bit = F.col(column).bitwiseXOR(F.shiftright(column, 17)).bitwiseAND(m - 1)
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(m // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return m, out.view(np.uint64)


def passes(ids: pa.Array, m: int, words: np.ndarray) -> np.ndarray:
    at = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bit = (at ^ (at >> 17)) & (m - 1)
    return ((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)


def split(docs: DataFrame, doc_id: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(possibly wanted, surely not): two scans of ``docs``, neither shuffled; only the ids pass through Python. ``ids`` has one long column, id."""
    m, words = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    small_batches(docs.sparkSession)
    wanted = F.arrow_udf(lambda at: pa.array(passes(at, m, shared.value)), "boolean")(F.col(f"`{doc_id}`"))
    return docs.filter(wanted), docs.filter(~wanted)


def keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` and a long column that orders its documents: ``doc_id`` itself, where every id is an integer with one text.

    Ids of another type, and rows that share an id but not the text, get numbers in
    the order of (id, digest of the text); equal rows share theirs, a null id has none.
    """
    own = F.col(f"`{doc_id}`")
    digest = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    thin = docs.select(own.alias("id"), digest.alias("digest")).where("id IS NOT NULL")
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType) and thin.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty():
        return docs, doc_id
    a, b, key = (fresh(x, docs.columns) for x in ("__cw_id", "__cw_digest", "__cw_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = thin.distinct().repartitionByRange(parts, "id", "digest").sortWithinPartitions("id", "digest")
    numbers = materialise(ordered.select(F.col("id").alias(a), F.col("digest").alias(b), F.monotonically_increasing_id().alias(key)))
    return docs.join(numbers, (own == F.col(a)) & (digest == F.col(b)), "left").drop(a, b), key


def with_runs(docs: DataFrame, doc_id: str, runs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a last column that holds the runs of each id flattened, null where there are none; and its name.

    ``runs`` has columns id (long) and runs (array of long); it must be cut from
    its lineage, for it is read twice.
    """
    key, name = fresh("__cw_id", docs.columns), fresh("__cw_runs", docs.columns)
    by_id = runs.groupBy(F.col("id").alias(key)).agg(F.flatten(F.collect_list("runs")).alias(name))
    hit, free = split(docs, doc_id, runs.select("id").distinct())
    joined = hit.join(by_id, F.col(doc_id) == F.col(key), "left").select(*docs.columns, name)
    return joined.unionByName(free.withColumn(name, F.lit(None).cast("array<bigint>"))), name


def without(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose id is in ``gone`` (one column of the ids' type, without nulls); only rows that may be gone are shuffled."""
    own = F.col(f"`{doc_id}`")
    digest, key = fresh("__cw_digest", docs.columns), fresh("__cw_gone", docs.columns)
    gone = materialise(gone.toDF(key).distinct())
    hit, free = split(docs.withColumn(digest, F.xxhash64(own)), digest, gone.select(F.xxhash64(key).alias("id")))
    left = hit.join(gone, own == F.col(key), "left_anti")
    return left.unionByName(free).drop(digest)
