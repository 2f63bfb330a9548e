"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts may be long, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch size (a value the user has set is kept)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a folder under the temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "trialframe-shared")


def trim() -> None:
    """Give what this worker has freed back to the system: workers are kept for later tasks, which share the executor's memory with them."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here delete their shuffle files, which otherwise stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, and the files outlive any executor. Columns and types stay the same. No shuffle files are left.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/trialframe-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trialframe_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote, when nothing reads it any more."""
    path = getattr(df, "_trialframe_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch. Strings that it reads as bytes must be cast to binary before."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def spread_join(left: DataFrame, right: DataFrame, on: str, weight: str) -> DataFrame:
    """``left.join(right, on)`` for a ``right`` with one row a key and, in ``weight``, about how many rows of ``left`` have that key.

    Keys that would fill a good part of a task are joined by broadcast, so no task gets all rows of a hot key. Shares of a
    whole bound their number: four for each task at most, whatever the input.
    """
    parts = 4 * n_tasks(left.sparkSession)
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = [r[0] for r in right.where(F.col(weight) * parts > total).select(on).limit(parts).collect()]
    if not hot:
        return left.join(right, on)
    is_hot = F.col(on).isin(hot)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), on).unionByName(left.where(~is_hot).join(right.where(~is_hot), on))


def if_few(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (written, of a few numbers a row) marked for broadcast if it has at most ``rows`` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name`` or, if ``df`` has such a column, a longer name that it hasn't."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts == rest


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
