"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it; a temporary folder only where that is unset on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keyloom-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()
