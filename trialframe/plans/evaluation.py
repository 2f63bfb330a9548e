"""Evaluation of a checkpoint: prompts, completions, grades, summaries and logs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.chat import render
from ..operators.completion import Completer, complete
from ..operators.grading import Dialect, grade_completions, quick_grades
from ..operators.records import first_n, preference_pairs
from ..operators.synthesis import SYSTEM
from ..operators.trials import error_distribution, family_breakdown, summary_maps
from ..sources.files import summary_path, write_jsonl, write_object
from ..sources.shared import kept


def generation_prompt(records: DataFrame) -> DataFrame:
    """``records`` with ``rendered``: their system message and prompt, ready for a model."""
    asked = F.array(F.col("messages")[0], F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return records.withColumn("rendered", render(asked, True))


def evaluate_checkpoint(
    records: DataFrame, make: Callable[[], Completer], output: str | None = None, batch_size: int = 16, max_samples: int | None = None, timeout: float = 4.0,
    dialect: Dialect | None = None, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trials, summary) of ``records`` (SFT_RECORDS with ``seq``), written to ``output`` and beside it if given.

    Completions and trials are written to the shared folder when this is called: models and foreign code may do otherwise
    when they run again, and both results must come from one run. The times are those that the two steps took.
    """
    began = time.monotonic()
    done = kept(complete(generation_prompt(first_n(records, max_samples)), make, batch_size=batch_size), "completions")
    generated = time.monotonic()
    trials = kept(grade_completions(done, timeout=timeout, dialect=dialect, tasks=tasks), "trials")
    graded = time.monotonic()
    summary = summary_maps(trials).select(
        F.col("n").alias("num_eval_samples"), F.col("pass_rate").alias("pass_rate_pass_at_1"), F.col("mean_score").alias("mean_stepped_score"),
        F.lit(graded - began).alias("total_eval_time_sec"), F.lit(generated - began).alias("generation_time_sec"), F.lit(graded - generated).alias("grading_time_sec"),
        "error_distribution", "family_breakdown",
    )
    if output:
        write_jsonl(trials, output, "seq")
        write_object(summary, summary_path(output))
    return trials, summary


def rows_per_second(rows: Column, seconds: Column) -> Column:
    """Throughput; 0 where no time has passed."""
    return F.coalesce(F.try_divide(rows.cast("double"), F.when(seconds > 0, seconds.cast("double"))), F.lit(0.0))


def with_throughput(summary: DataFrame) -> DataFrame:
    """A summary with rows a second of generation, grading and the whole."""
    n = F.col("num_eval_samples")
    return summary.select("*", *[rows_per_second(n, F.col(f"{p}_time_sec")).alias(f"{p}_per_sec") for p in ("generation", "grading", "total_eval")])


def watched(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Callable[[], int]]:
    """``rows``, and a function that tells how many went by, once they have been used; they are not counted by a job of their own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), lambda: seen.get["n"]


def build_pairs(
    records: DataFrame, make: Callable[[], Completer], output: str | None = None, batch_size: int = 16, max_prompts: int | None = 300, timeout: float = 10.0,
    dialect: Dialect | None = None, tasks: int | None = None, system: str = SYSTEM,
) -> DataFrame:
    """Preference pairs from ``records`` (SFT_RECORDS with ``seq``): each prompt is completed and the completion run; a row for
    each that fails, the canonical code chosen and the completion rejected. Written to ``output`` if given."""
    done = complete(generation_prompt(first_n(records, max_prompts)), make, batch_size=batch_size)
    graded = kept(quick_grades(done, timeout=timeout, dialect=dialect, tasks=tasks), "graded")
    pairs = preference_pairs(graded, system)
    if output:
        write_jsonl(pairs, output, "id")
    return pairs


__all__ = ["build_pairs", "error_distribution", "evaluate_checkpoint", "family_breakdown", "generation_prompt", "rows_per_second", "watched", "with_throughput"]
