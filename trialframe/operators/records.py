"""Training records: supervised records, preference pairs, splits, limits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fence_unless_fenced, fenced, padded
from .ordering import numbered as dense
from .synthesis import SYSTEM


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_records(rows: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Records in the schema SFT_RECORDS from ``id, task_family, complexity, constraint_types, prompt, code,
    num_trials, num_factors, exec_time_sec``."""
    chat = F.array(message("system", F.lit(system)), message("user", F.col("prompt")), message("assistant", fenced(F.col("code"))))
    meta = F.struct(F.col("num_trials").cast("int").alias("num_trials"), F.col("num_factors").cast("int").alias("num_factors"), F.col("exec_time_sec").cast("double").alias("exec_time_sec"))
    return rows.select("id", "task_family", "complexity", "constraint_types", chat.alias("messages"), "prompt", F.col("code").alias("canonical_code"), meta.alias("meta"))


def numbered(rows: DataFrame, prefix: str, order: str, partition: str | None = None) -> DataFrame:
    """``rows`` with ``id`` ``prefix_00000`` on in ``order`` (a number), for each ``partition`` if given, which is then the prefix."""
    out = dense(rows, order, name="_number", partition=partition)
    return out.withColumn("id", padded(F.col(partition) if partition else F.lit(prefix), F.col("_number"))).drop("_number")


def preference_pairs(graded: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Pairs in the schema PREFERENCE_PAIRS from ``seq, task_family, prompt, canonical_code, completion, passed, error``:
    a row for each completion that failed; the canonical code is chosen, the completion rejected. The system message is that
    of ``messages`` where that column is there."""
    failed = numbered(graded.where(~F.col("passed")), "dpo", "seq")
    told = F.col("messages")[0]["content"] if "messages" in graded.columns else F.lit(system)
    said = lambda text: F.array(message("system", told), message("user", F.col("prompt")), message("assistant", text))
    return failed.select(
        "id", F.coalesce("task_family", F.lit("unknown")).alias("task_family"), "prompt", said(fenced(F.col("canonical_code"))).alias("chosen"),
        said(fence_unless_fenced(F.col("completion"))).alias("rejected"), F.col("error").alias("rejected_error"),
    )


def first_n(rows: DataFrame, n: int | None, order: str = "seq") -> DataFrame:
    """The first ``n`` rows; all for None and 0."""
    return rows.orderBy(order).limit(n) if n else rows


def batches(rows: DataFrame, size: int = 16, order: str = "seq") -> DataFrame:
    """``rows`` with their ``batch`` of ``size`` and place ``slot`` in it; ``order`` numbers rows from 0 without gaps."""
    return rows.withColumn("batch", F.floor(F.col(order) / F.lit(size))).withColumn("slot", F.col(order) % size)


def union_splits(**splits: DataFrame) -> DataFrame:
    """All rows of the named splits, with ``split``."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_test_overlap(train: DataFrame, test: DataFrame, column: str = "prompt") -> DataFrame:
    """Rows of ``test`` whose ``column`` occurs in ``train``."""
    return test.join(train.select(column).distinct(), column, "left_semi")
