"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "trialframe-files")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """``rows`` written as Parquet and read back: fixed whatever executor is lost."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
