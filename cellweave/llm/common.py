"""Helpers shared by the operators: reading tables, mapping texts, cutting lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name in columns:
        name += "_"
    return name


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster shares (``shared_folder``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session whose tasks all run
    on this machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of ids or links that one task takes with ease.
TASK_ROWS = 1 << 16


def compact(df: DataFrame) -> DataFrame:
    """``materialise``, read back by as many tasks as its counted rows need: a small table leaves few small files in the shuffles that follow."""
    out = materialise(df)
    return out.coalesce(out.count() // TASK_ROWS + 1)


def release() -> None:
    """Forget plans that nothing refers to any more, so that Spark's cleaner can drop their shuffle files."""
    gc.collect()


def recounted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_chars``, where there is such a column, counted again from texts that have changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))


#: Bytes of an Arrow batch between the JVM and Python: both sides hold a few per task. Rows of whole texts that the Parquet reader holds at once.
BATCH_BYTES, READ_ROWS = 2 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes and its Parquet batches by rows, where they are not bounded lower.

    Rows here hold whole texts; the session's defaults are made for rows of numbers.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows into parts of about ``limit`` bytes of a string or binary column."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - 1) // limit
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(edge.tolist(), np.append(edge[1:], batch.num_rows).tolist()):
        yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches of a task put together until they hold ``limit`` bytes of a string column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.fill_null(pc.binary_length(batch.column(column)), 0)).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str, limit: tuple[str, int] | None = None) -> DataFrame:
    """Apply ``fn`` to every Arrow batch, or to parts of it of at most so many bytes of a column (``limit``: name, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from map(fn, [batch] if limit is None else slices(batch, batch.schema.get_field_index(limit[0]), limit[1]))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def derived(df: DataFrame, fn: Callable[..., dict[str, pa.Array]], fields: T.StructType, *inputs: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, a struct of ``fields`` that ``fn`` makes from Arrow arrays of the ``inputs``; and its name.

    Only the inputs travel to Python and only the struct comes back; no column of
    ``df`` is touched, whatever its name.
    """
    name = fresh("__cw_made", df.columns)

    def made(*columns: pa.Array) -> pa.Array:
        got = fn(*columns)
        return pa.StructArray.from_arrays([got[x] for x in fields.fieldNames()], names=fields.fieldNames())

    small_batches(df.sparkSession)
    udf = F.arrow_udf(made, fields).asNondeterministic()  # once a row, wherever the result is used
    return df.withColumn(name, udf(*(F.col(f"`{x}`") for x in inputs))), name


def rewritten(df: DataFrame, text: str, fn: Callable[..., pa.Array], *inputs: str) -> DataFrame:
    """``df`` with the column ``text`` as ``fn`` makes it from Arrow arrays of ``text`` and the ``inputs``."""
    small_batches(df.sparkSession)
    udf = F.arrow_udf(lambda *columns: fn(*columns), df.schema[text].dataType).asNondeterministic()
    return df.withColumn(text, udf(F.col(f"`{text}`"), *(F.col(f"`{x}`") for x in inputs)))


def add_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], dict[str, pa.Array]], added: T.StructType) -> DataFrame:
    """``df`` with the columns that ``fn`` derives from ``text``; input columns of these names are replaced."""
    kept = [x for x in df.columns if x not in added.fieldNames()]
    out, name = derived(df, fn, added, text)
    return out.select(*(F.col(f"`{x}`") for x in kept), f"{name}.*")
