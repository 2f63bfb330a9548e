"""The test tables seen as trials, completions, conversations and designs. Each has a twin in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LADDER_ERRORS = ["SyntaxError", "TimeoutExpired", "SubprocessCrash", "ValueError", "NoExperimentsProduced", "SynthesisError_KeyError"]
LADDER_SCORES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.6]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nth(values: list, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def trials(spark: SparkSession, sf_dir: str, side: str = "b") -> DataFrame:
    """Labelled documents as a trial log: ``toxic`` decides side a, ``quality`` side b."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    passed = F.col("toxic" if side == "a" else "quality") == 1
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("task_family"), "lang",
        F.when(F.col("n_chars") < 1000, "simple").when(F.col("n_chars") < 4000, "medium").otherwise("complex").alias("complexity"),
        passed.alias("passed"), F.when(passed, F.lit(1.0)).otherwise(_nth(LADDER_SCORES, F.col("doc_id"))).alias("score"),
        F.when(~passed, _nth(LADDER_ERRORS, F.col("doc_id"))).alias("error_type"),
    )


def _trial_sql(name: str, column: str) -> str:
    return f"""{name} AS (
  SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS id, d.source AS task_family, d.lang AS lang,
         CASE WHEN d.n_chars < 1000 THEN 'simple' WHEN d.n_chars < 4000 THEN 'medium' ELSE 'complex' END AS complexity,
         l.{column} = 1 AS passed,
         CAST(CASE WHEN l.{column} = 1 THEN 1.0 ELSE ({LADDER_SCORES})[CAST(d.doc_id % 6 + 1 AS INT)] END AS DOUBLE) AS score,
         CASE WHEN l.{column} = 1 THEN NULL ELSE ({LADDER_ERRORS})[CAST(d.doc_id % 6 + 1 AS INT)] END AS error_type
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


A_SQL, B_SQL = _trial_sql("a", "toxic"), _trial_sql("b", "quality")
PAIRS_SQL = f"""{A_SQL}, {B_SQL}, pairs AS (
  SELECT a.id, CAST(a.passed AS INT)::DOUBLE AS value_a, CAST(b.passed AS INT)::DOUBLE AS value_b,
         CAST(b.passed AS INT)::DOUBLE - CAST(a.passed AS INT)::DOUBLE AS diff
  FROM a JOIN b ON a.id = b.id)"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as completions: fenced, in two fences, or bare text, by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fence, t = F.lit("```"), F.col("text")
    one = F.concat(F.lit("Here it is:\n"), fence, F.lit("python\n"), t, F.lit("\n"), fence, F.lit("\nDone."))
    two = F.concat(fence, F.lit("PYTHON\nfirst\n"), fence, F.lit(" then\n"), fence, F.lit("\n"), t, F.lit("\n"), fence)
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, two).otherwise(t).alias("completion"))


COMPLETIONS_SQL = """completions AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
                                 WHEN 1 THEN '```PYTHON' || chr(10) || 'first' || chr(10) || '``` then' || chr(10) || '```' || chr(10) || text || chr(10) || '```'
                                 ELSE text END AS completion
  FROM documents)"""


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as designs: a user's events in time order are the trials, event type and value band the factors."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    rows = e.select(F.col("user_id").alias("design_id"), order.alias("trial_idx"), F.col("event_type").alias("kind"), F.when(F.col("value") < 50, "low").otherwise("high").alias("band"), "event_id")
    return rows


DESIGNS_SQL = """designs AS (
  SELECT user_id AS design_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trial_idx, event_type AS kind,
         CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS band, event_id
  FROM events)"""
