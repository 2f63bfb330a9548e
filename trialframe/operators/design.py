"""Validators of trial sequences: tables with a design id, a trial's place in it, and factor columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crossing_counts(trials: DataFrame, factors: list[str], levels: DataFrame, excluded: Column | None = None, design: str = "design_id") -> DataFrame:
    """``design, factors, n`` of every expected cell. ``levels`` has a row for each cell (full, or part of the factors);
    cells that ``excluded`` holds for are not expected. A cell that never occurs has n 0."""
    cells = levels if excluded is None else levels.where(~excluded)
    grid = trials.select(design).distinct().join(cells)
    counts = trials.groupBy(design, *factors).agg(F.count("*").alias("n"))
    return grid.join(counts, [design, *factors], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def balanced(counts: DataFrame, design: str = "design_id") -> DataFrame:
    """Whether a design's expected cells occur equally often."""
    return counts.groupBy(design).agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("balanced", F.col("least") == F.col("most"))


def minimum_trials(trials: DataFrame, least: int, design: str = "design_id") -> DataFrame:
    return trials.groupBy(design).agg(F.count("*").alias("n")).withColumn("ok", F.col("n") >= least)


def run_lengths(trials: DataFrame, factor: str, design: str = "design_id", place: str = "trial_idx") -> DataFrame:
    """``design, factor, run_start, run_length`` of each unbroken run of a level."""
    by, same = Window.partitionBy(design).orderBy(place), Window.partitionBy(design, factor).orderBy(place)
    island = trials.withColumn("_g", F.row_number().over(by) - F.row_number().over(same))
    return island.groupBy(design, factor, "_g").agg(F.min(place).alias("run_start"), F.count("*").alias("run_length")).drop("_g")


def at_most_in_a_row(trials: DataFrame, factor: str, level: str, most: int, design: str = "design_id", place: str = "trial_idx") -> DataFrame:
    runs = run_lengths(trials, factor, design, place).where(F.col(factor) == level)
    longest = runs.groupBy(design).agg(F.max("run_length").alias("longest"))
    return trials.select(design).distinct().join(longest, design, "left").select(design, F.coalesce("longest", F.lit(0)).alias("longest")).withColumn("ok", F.col("longest") <= most)


def within_trial(trials: DataFrame, one: str, other: str) -> DataFrame:
    return trials.withColumn("congruency", F.when(F.col(one) == F.col(other), "congruent").otherwise("incongruent"))


def transition(trials: DataFrame, factor: str, design: str = "design_id", place: str = "trial_idx") -> DataFrame:
    """``transition``: repeat or switch against the trial before; null for the first."""
    return back(trials, factor, 1, design, place, "transition", "repeat", "switch")


def back(trials: DataFrame, factor: str, n: int, design: str = "design_id", place: str = "trial_idx", name: str = "target", yes: str = "target", no: str = "lure") -> DataFrame:
    """``name`` from the trial ``n`` before: ``yes`` if equal, else ``no``; null for the first ``n``."""
    w = Window.partitionBy(design).orderBy(place)
    before = F.lag(factor, n).over(w)
    return trials.withColumn(name, F.when(F.row_number().over(w) > n, F.when(before.eqNullSafe(F.col(factor)), yes).otherwise(no)))


def exclude_and_pin(trials: DataFrame, factor: str, gone: str, pinned: str, level: str, at: int, design: str = "design_id", place: str = "trial_idx") -> DataFrame:
    """``n_excluded`` trials with ``factor`` at ``gone``, and whether ``pinned`` is at ``level`` in the trial at place ``at``."""
    agg = trials.groupBy(design).agg(F.count_if(F.col(factor) == gone).alias("n_excluded"), F.max(F.when(F.col(place) == at, (F.col(pinned) == level).cast("int"))).alias("p"))
    return agg.select(design, "n_excluded", (F.coalesce("p", F.lit(0)) == 1).alias("pin_ok"))
