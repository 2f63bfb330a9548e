"""Aggregations and pairings over trial tables (id, seq, task_family, complexity, passed, score, error_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def overall_summary(trials: DataFrame) -> DataFrame:
    """One row: n, n_passed, pass_rate and mean_score."""
    agg = trials.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"))
    return agg.select("n", "n_passed", ratio(F.col("n_passed"), F.col("n")).alias("pass_rate"), ratio(F.col("s"), F.col("n")).alias("mean_score"))


def family_breakdown(trials: DataFrame, key: str = "task_family") -> DataFrame:
    """One row for each family, in order of first appearance (``first_seq``)."""
    agg = trials.groupBy(key).agg(F.count("*").alias("n"), F.count_if("passed").alias("p"), F.sum("score").alias("s"), F.min("seq").alias("first_seq"))
    out = agg.select(key, ratio(F.col("p"), F.col("n")).alias("pass_rate"), ratio(F.col("s"), F.col("n")).alias("mean_score"), "n", "first_seq")
    return out.orderBy("first_seq")


def error_distribution(trials: DataFrame) -> DataFrame:
    """Counts of error types; null and empty ones are no errors."""
    return trials.where("error_type is not null and error_type <> ''").groupBy("error_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy("first_seq")


def counts_by(trials: DataFrame, *keys: str) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count("*").alias("n"))


def rollup_summary(trials: DataFrame, key: str = "task_family") -> DataFrame:
    """Overall row (``is_total`` 1, null family) and family rows in one pass."""
    agg = trials.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), F.count("*").alias("n"), F.count_if("passed").alias("p"), F.sum("score").alias("s"))
    return agg.select(key, "is_total", "n", ratio(F.col("p"), F.col("n")).alias("pass_rate"), ratio(F.col("s"), F.col("n")).alias("mean_score"))


def summary_maps(trials: DataFrame) -> DataFrame:
    """One row with the summary's two maps, entries in order of first appearance."""
    fam = F.array_sort(F.collect_list(F.struct("first_seq", "task_family", F.struct("pass_rate", "mean_score", "n").alias("v"))))
    err = F.array_sort(F.collect_list(F.struct("first_seq", "error_type", "n")))
    families = family_breakdown(trials).agg(F.map_from_entries(F.transform(fam, lambda x: F.struct(x["task_family"], x["v"]))).alias("family_breakdown"))
    errors = error_distribution(trials).agg(F.map_from_entries(F.transform(err, lambda x: F.struct(x["error_type"], x["n"]))).alias("error_distribution"))
    return overall_summary(trials).join(families).join(errors)  # rows of one each


def checked_metric(trials: DataFrame, metric: str) -> DataFrame:
    """``trials`` with ``metric`` as a double; a null raises instead of being left out of a mean."""
    kind = dict(trials.dtypes)[metric]
    value = F.col(metric).cast("double") if kind != "boolean" else F.col(metric).cast("int").cast("double")
    return trials.withColumn(metric, F.when(F.col(metric).isNull(), F.raise_error(F.lit(f"{metric} is null"))).otherwise(value))


def paired(a: DataFrame, b: DataFrame, metric: str = "passed") -> DataFrame:
    """``id, value_a, value_b, diff`` of two logs of the same items, joined on their ids."""
    left = checked_metric(a, metric).select("id", F.col(metric).alias("value_a"))
    right = checked_metric(b, metric).select("id", F.col(metric).alias("value_b"))
    return left.join(right, "id").withColumn("diff", F.col("value_b") - F.col("value_a"))


def check_pairing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows and distinct ids of each log and ids without a partner. All is well if ``ok``."""
    ids = a.select("id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = ids.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = per.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("rows_b"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated_ids"),
        F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"),
    )
    return out.withColumn("ok", (F.col("repeated_ids") == 0) & (F.col("only_a") == 0) & (F.col("only_b") == 0))


def positional_pairs(a: DataFrame, b: DataFrame, metric: str = "passed") -> DataFrame:
    """As ``paired``, by place (``pos``, from 1) in ``seq`` order. For logs whose ids do not match."""
    placed = lambda log, name: numbered(checked_metric(log, metric).select("seq", F.col(metric).alias(name)), "seq", name="pos").select((F.col("pos") + 1).alias("pos"), name)
    left, right = placed(a, "value_a"), placed(b, "value_b")
    return left.join(right, "pos").withColumn("diff", F.col("value_b") - F.col("value_a"))


def cluster_stats(a: DataFrame, b: DataFrame, cluster: str = "task_family", metric: str = "passed") -> DataFrame:
    """Sufficient statistics of each cluster of ``a``: ``idx`` (0-based, in code-point order), n and sum of both logs.

    Clusters that only ``b`` has are left out; where ``b`` has none of a cluster its n and sum are 0.
    """
    left = checked_metric(a, metric).groupBy(cluster).agg(F.count("*").alias("n_a"), F.sum(metric).alias("s_a"))
    right = checked_metric(b, metric).groupBy(cluster).agg(F.count("*").alias("n_b"), F.sum(metric).alias("s_b"))
    both = left.join(right, cluster, "left").withColumn("n_b", F.coalesce("n_b", F.lit(0))).withColumn("s_b", F.coalesce("s_b", F.lit(0.0)))
    # A row for each cluster, added up before: one task may number them.
    return both.withColumn("idx", F.row_number().over(Window.orderBy(cluster)) - 1)
