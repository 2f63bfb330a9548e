"""Running summaries of a stream of trials; counts and sums add up, so update mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trials import ratio
from ..schemas import TRIALS


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRIALS).option("mode", "FAILFAST").json(path)


def running_breakdown(trials: DataFrame, key: str = "task_family") -> DataFrame:
    """``key, pass_rate, mean_score, n`` so far; write it in update or complete mode."""
    agg = trials.groupBy(key).agg(F.count("*").alias("n"), F.count_if("passed").alias("p"), F.sum("score").alias("s"))
    return agg.select(key, ratio(F.col("p"), F.col("n")).alias("pass_rate"), ratio(F.col("s"), F.col("n")).alias("mean_score"), "n")
