"""Session helpers: cutting lineage where a plan is iterative."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session whose tasks all run on
    this machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the cluster shares (``shared_folder``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
