"""Queries of sources, sinks, the command line and text expressions, beside those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import cli
from ..functions import text
from ..operators import design, ordering, resampling, synthesis, trials
from ..sources import files
from ..sources.shared import shared_path
from . import evaluation
from .proxy import A_SQL, B_SQL, DESIGNS_SQL, designs, table
from .proxy import trials as trial_log
from .registry import query, r6
from .report import markdown, report_rows


def attach(report_sql: str) -> None:
    """Queries whose SQL builds on the report's."""
    lines = """SELECT '| ' || model || ' | ' || printf('%.1f', 100 * pass_rate) || ' % (' || n_passed || '/' || n || ') | ' || printf('%.4f', mean_score) || ' | ' ||
 CASE WHEN delta IS NULL THEN '-' ELSE printf('%+.1f', 100 * delta) || ' % [' || printf('%+.1f', 100 * ci_low) || ', ' || printf('%+.1f', 100 * ci_high) || ']' END || ' | ' ||
 CASE WHEN p_value IS NULL THEN '-' ELSE printf('%.4f', greatest(p_value, 0.0001)) END || ' | ' || verdict || ' |' AS line FROM report"""

    @query(f"{report_sql} {lines}")
    def report_markdown(spark, sf_dir):
        """The report as text, a row for each line but the two of its head."""
        a, b = trial_log(spark, sf_dir, "a"), trial_log(spark, sf_dir, "b")
        made = markdown(report_rows({"a": a, "b": b}, "a")).splitlines()[2:]
        return spark.createDataFrame([(x,) for x in made], "line string")

    @query(f"{report_sql} {lines}")
    def cli_report(spark, sf_dir):
        """The command line's ``analyze`` over two written logs."""
        folder = shared_path(spark, "cli")
        for side in "ab":
            log = trial_log(spark, sf_dir, side).select("id", "task_family", "complexity", "passed", "score", "error_type")
            files.write_jsonl(log, f"{folder}/{side}.jsonl", one_file=False)
        cli.main(["analyze", "--baseline", f"a={folder}/a.jsonl", "--log", f"b={folder}/b.jsonl", "--output-file", f"{folder}/report.md"], spark)
        return spark.read.text(f"{folder}/report.md").where("value LIKE '| a |%' OR value LIKE '| b |%'").select(F.col("value").alias("line"))


# ---- sources and sinks ----------------------------------------------------------------------------------------


@query("SELECT doc_id, source, text FROM documents")
def jsonl_inferred(spark, sf_dir):
    path = shared_path(spark, "inferred")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, one_file=False)
    return files.infer_jsonl(spark, path).select("doc_id", "source", "text")


@query("SELECT conv_id, turn, role FROM conversations")
def jsonl_one_file(spark, sf_dir):
    """One file in order, read back with blank lines between its lines."""
    path = shared_path(spark, "one") + "/turns.jsonl"
    files.write_jsonl(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), path, "conv_id")
    blank = shared_path(spark, "blank")
    spark.read.text(path).select(F.concat("value", F.lit("\n \n")).alias("value")).write.text(blank)
    return files.read_jsonl(spark, blank, "conv_id bigint, turn bigint, role string")


@query(f"WITH {B_SQL} SELECT count(*) AS n, count(*) FILTER (passed) AS n_passed, round(avg(CAST(passed AS INT)), 6) AS pass_rate FROM b")
def summary_object(spark, sf_dir):
    path = files.summary_path(shared_path(spark, "log") + ".jsonl")
    files.write_object(r6(trials.overall_summary(trial_log(spark, sf_dir)).select("n", "n_passed", "pass_rate"), "pass_rate"), path)
    return spark.read.schema("n bigint, n_passed bigint, pass_rate double").option("multiLine", True).json(path)


CONFIG = """model:
  name: some-model
  max_length: 1024  # right side
training:
  learning_rate: 2.0e-4
  packing: false
  targets:
    - q_proj
    - v_proj
seed: 42
"""


@query("""SELECT key, value FROM (VALUES ('model.name', 'some-model'), ('model.max_length', '1024'), ('training.learning_rate', '0.0002'), ('training.packing', 'False'),
 ('training.targets', '[''q_proj'', ''v_proj'']'), ('seed', '42')) t(key, value)""")
def config_values(spark, sf_dir):
    nested = files.parse_simple_yaml(CONFIG)
    flat = [(f"{k}.{j}" if isinstance(v, dict) else k, str(x)) for k, v in nested.items() for j, x in (v.items() if isinstance(v, dict) else [(k, v)])]
    return spark.createDataFrame(flat, "key string, value string")


@query(f"WITH {B_SQL} SELECT id, task_family FROM b")
def progress_counted(spark, sf_dir):
    """Rows that are watched on their way; the count is there once they have been used."""
    rows, seen = evaluation.watched(trial_log(spark, sf_dir).select("id", "task_family"), "trials")
    n = rows.count()
    if seen() != n:
        raise ValueError(f"{seen()} of {n} rows were seen")
    return rows


@query(f"WITH {B_SQL} SELECT task_family, count(*) AS n, CAST(coalesce(count(*) / nullif(sum(CASE WHEN passed THEN 1 ELSE 0 END), 0), 0) AS DOUBLE) AS per_second FROM b GROUP BY task_family")
def throughput(spark, sf_dir):
    """Rows a second; a family's passes stand in for its seconds, none for no time."""
    per = trial_log(spark, sf_dir).groupBy("task_family").agg(F.count("*").alias("n"), F.count_if("passed").alias("s"))
    return per.select("task_family", "n", evaluation.rows_per_second(F.col("n"), F.col("s")).alias("per_second"))


# ---- order ----------------------------------------------------------------------------------------------------


@query("""WITH items AS (SELECT CAST(c_custkey % 997 AS VARCHAR) AS id, c_custkey AS seq FROM customer),
last AS (SELECT id, max(seq) AS place FROM items GROUP BY id)
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, coalesce(place, 0) AS seq FROM supplier LEFT JOIN last ON last.id = CAST(s_suppkey AS VARCHAR)""")
def reorder_by_id(spark, sf_dir):
    """Rows take the last place of their id in a list; 0 for ids that it lacks."""
    items = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 997).cast("string").alias("id"), F.col("c_custkey").alias("seq"))
    return ordering.reordered(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")), items)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS number FROM orders")
def dense_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ordering.numbered(rows, "o_orderkey", partition="o_orderpriority").select("o_orderkey", "number")


# ---- text -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, replace(replace('<{id}> ' || chr(10) || '{body}', '{id}', CAST(doc_id AS VARCHAR)), '{body}', text) AS filled FROM documents")
def literal_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.filled("<{id}> \n{body}", id=F.col("doc_id").cast("string"), body=F.col("text")).alias("filled"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '    ' || x), chr(10)) AS code FROM documents")
def indented_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.indented(F.col("text")).alias("code"))


@query("""SELECT o_orderkey, printf('%.1f', v) AS f1, printf('%.2f', v) AS f2, printf('%.3f', v) AS f3, printf('%.4f', v) AS f4, printf('%.4e', v) AS e4
FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) + 0.00123 AS v FROM orders)""")
def number_formats(spark, sf_dir):
    """The reports' number formats; the small addend keeps values off ties, which engines round differently."""
    v = text.number_texts(F.col("o_totalprice").cast("double") + 0.00123)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


# ---- statistics and designs -----------------------------------------------------------------------------------


@query(f"WITH {A_SQL} SELECT count(*) AS n, 0.0::DOUBLE AS sd, round({text.normal_quantile(0.975) + text.normal_quantile(0.8)!r}::DOUBLE * 0.1 / sqrt(count(*)), 6) AS mde FROM a")
def mde_compat(spark, sf_dir):
    """A log against itself has no spread; 0.1 stands in for it."""
    a = trial_log(spark, sf_dir, "a")
    return r6(resampling.detectable_effect(trials.paired(a, a), compat=True), "sd", "mde")


@query(f"WITH {DESIGNS_SQL}, g AS (SELECT * FROM (SELECT DISTINCT design_id FROM designs), (SELECT DISTINCT band FROM designs)) SELECT g.design_id, g.band, count(d.event_id) AS n FROM g LEFT JOIN designs d USING (design_id, band) GROUP BY ALL")
def design_partial_crossing(spark, sf_dir):
    """Only ``band`` is crossed; ``kind`` varies freely."""
    d = designs(spark, sf_dir)
    return design.crossing_counts(d, ["band"], d.select("band").distinct())


_G = "('0x' || substr(md5('42|' || a || '|generator'), 1, 8))::BIGINT % 6"
_C = "('0x' || substr(md5('42|' || a || '|c'), 1, 8))::BIGINT % 3"
_FAMILY = f"CASE {_G} WHEN 0 THEN 'factorial_crossing' WHEN 1 THEN CASE {_C} WHEN 0 THEN 'stroop_congruency' ELSE 'flanker_task' END WHEN 2 THEN 'task_switching_transition' WHEN 3 THEN 'nback_window' WHEN 4 THEN 'constrained_design' ELSE 'partial_crossing' END"


@query(f"SELECT task_family, count(*) AS n FROM (SELECT {_FAMILY} AS task_family FROM range(2000) t(a)) GROUP BY ALL")
def synth_mixture(spark, sf_dir):
    return trials.counts_by(synthesis.samples(spark, 2000), "task_family")


def _split_sql(name: str, seed: int, n: int) -> str:
    family = _FAMILY.replace("'42|'", f"'{seed}|'")
    return f"SELECT '{name}' AS split, '{name}_' || printf('%05d', a) AS id, a AS attempt, {family} AS task_family, true AS has_trials FROM range({n}) t(a)"


SPLIT_SIZES = {"train": 24, "val": 8, "test_heldout": 8}


@query(" UNION ALL ".join(_split_sql(n, 42 + more, SPLIT_SIZES[n]) for n, more in synthesis.SPLITS))
def verified_splits(spark, sf_dir):
    """Three splits by seed; every program is run and all of them pass."""
    rows = synthesis.verified_splits(spark, SPLIT_SIZES, over=1.0)
    return rows.select("split", "id", "attempt", "task_family", ((F.col("num_trials") > 0) & (F.col("num_factors") > 0)).alias("has_trials"))


@query("SELECT t AS temperature, t <= 0.0001 AS greedy FROM (SELECT i / 20000.0::DOUBLE AS t FROM range(0, 20000, 1) r(i))")
def decoding_modes(spark, sf_dir):
    from ..operators.completion import is_greedy

    t = spark.range(20_000).select((F.col("id") / F.lit(20_000.0)).alias("temperature"))
    return t.select("temperature", is_greedy(F.col("temperature")).alias("greedy"))
