"""Queries over the test tables for the operators of this package, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .curriculum import curriculum
from .decontaminate import find_leaks
from .htmlblocks import extract
from .langid import identify
from .paragraphs import repeated_passages
from .pii import find_personal_data
from .quality import quality_rules
from .simhash import near_duplicates
from .suffixtree import score_texts
from .urlfilter import filter_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and from each copy's training position the first and the last, to nine places."""
    rows = curriculum(table(spark, sf_dir, "documents"))
    last = F.try_element_at("positions", F.lit(-1))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"), F.round("position", 9).alias("first_position"), F.round(last, 9).alias("last_position"))


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_language_id, op2_paragraph_dedup, op3_mix_curriculum, op4_suffix_tree_scores, op5_personal_data, op6_url_filter,
    op7_decontaminate, op8_quality_outliers, op9_main_text, op10_simhash_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([3, 1, 2])[ord % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most,
         sum(source_size) OVER () * 150 / 100.0::DOUBLE AS goal
  FROM per),
ranked AS (
  SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY most / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aimed AS (
  SELECT source, source_size, ord, least(most, coalesce(weight * (
           SELECT level FROM ranked WHERE level * weight <= most ORDER BY most / weight, ord LIMIT 1), most)) AS target
  FROM ranked),
laid AS (
  SELECT doc_id, s.source, size, source_size, target, ord,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS begin
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
counted AS (
  SELECT *, (CASE WHEN size = 0 THEN 0 ELSE (begin + size / 2.0 < target)::BIGINT + (begin + size / 2.0 + source_size < target)::BIGINT END)::BIGINT AS copies
  FROM laid),
-- Shares of the target delivered before the first and the last copy, and the time t at which each schedule's integral has that
-- share: 1.5 t - t*t/2 for rates that fall from 1.5 to 0.5, (t + t*t) / 2 for rates that rise from 0.5 to 1.5, t for an even one.
shares AS (SELECT *, begin / target AS a, (begin + (copies - 1) * source_size) / target AS b FROM counted)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
       round(CASE WHEN copies > 0 THEN CASE ord % 3 WHEN 0 THEN 1.5::DOUBLE - sqrt(2.25::DOUBLE - 2 * a) WHEN 1 THEN (sqrt(1 + 8 * a) - 1) / 2 ELSE a END END, 9) AS first_position,
       round(CASE WHEN copies > 0 THEN CASE ord % 3 WHEN 0 THEN 1.5::DOUBLE - sqrt(2.25::DOUBLE - 2 * b) WHEN 1 THEN (sqrt(1 + 8 * b) - 1) / 2 ELSE b END END, 9) AS last_position
FROM shares
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_curriculum": OP3}
