"""Query catalogue: each operator over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, text
from ..functions.draws import draw
from ..operators import design, grading, records, resampling, synthesis, trials
from ..sources import files
from ..sources.shared import shared_path
from .proxy import A_SQL, B_SQL, COMPLETIONS_SQL, DESIGNS_SQL, PAIRS_SQL, completions, designs, table
from .proxy import trials as trial_log
from .registry import ORACLE, QUERIES, query, r6
from .report import report_rows

N_BOOT, N_PERM, N_SIMS = 5000, 10_000, 1000
Z = text.normal_quantile(0.975) + text.normal_quantile(0.8)

# ---- aggregation ----------------------------------------------------------------------------------------------


@query(f"WITH {B_SQL} SELECT count(*) AS n, count(*) FILTER (passed) AS n_passed, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(score), 6) AS mean_score FROM b")
def trial_overall_summary(spark, sf_dir):
    return r6(trials.overall_summary(trial_log(spark, sf_dir)), "pass_rate", "mean_score")


@query(f"WITH {B_SQL} SELECT task_family, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(score), 6) AS mean_score, count(*) AS n, min(seq) AS first_seq FROM b GROUP BY task_family")
def family_breakdown(spark, sf_dir):
    return r6(trials.family_breakdown(trial_log(spark, sf_dir)), "pass_rate", "mean_score")


@query(f"WITH {B_SQL} SELECT error_type, count(*) AS n, min(seq) AS first_seq FROM b WHERE error_type IS NOT NULL AND error_type <> '' GROUP BY error_type")
def error_distribution(spark, sf_dir):
    return trials.error_distribution(trial_log(spark, sf_dir))


@query(f"WITH {B_SQL} SELECT complexity, task_family, count(*) AS n FROM b GROUP BY ALL")
def family_complexity_counts(spark, sf_dir):
    return trials.counts_by(trial_log(spark, sf_dir), "complexity", "task_family")


@query(f"WITH {B_SQL} SELECT task_family, CAST(grouping(task_family) AS INT) AS is_total, count(*) AS n, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(score), 6) AS mean_score FROM b GROUP BY ROLLUP (task_family)")
def overall_and_family_rollup(spark, sf_dir):
    return r6(trials.rollup_summary(trial_log(spark, sf_dir)), "pass_rate", "mean_score")


@query(f"""WITH {B_SQL} SELECT 'family' AS entry, task_family AS name, count(*) AS n, round(avg(score), 6) AS mean_score FROM b GROUP BY task_family
UNION ALL SELECT 'error', error_type, count(*), NULL FROM b WHERE error_type <> '' GROUP BY error_type""")
def summary_maps(spark, sf_dir):
    maps = trials.summary_maps(trial_log(spark, sf_dir))
    fam = maps.select(F.explode("family_breakdown").alias("name", "v")).select(F.lit("family").alias("entry"), "name", F.col("v.n").alias("n"), F.round("v.mean_score", 6).alias("mean_score"))
    return fam.unionByName(maps.select(F.explode("error_distribution").alias("name", "n")).select(F.lit("error").alias("entry"), "name", "n", F.lit(None).cast("double").alias("mean_score")))


# ---- pairing and statistics -----------------------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL} SELECT id, value_a, value_b, diff FROM pairs")
def paired_outcomes(spark, sf_dir):
    return trials.paired(trial_log(spark, sf_dir, "a"), trial_log(spark, sf_dir, "b"))


@query(f"WITH {PAIRS_SQL}, n AS (SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b) SELECT rows_a, rows_b, 0 AS repeated_ids, 0 AS only_a, 0 AS only_b, true AS ok FROM n")
def pairing_check(spark, sf_dir):
    return trials.check_pairing(trial_log(spark, sf_dir, "a"), trial_log(spark, sf_dir, "b"))


@query(f"""WITH {A_SQL}, {B_SQL}, x AS (SELECT row_number() OVER (ORDER BY seq) AS pos, CAST(passed AS INT)::DOUBLE AS value_a FROM a), y AS (SELECT row_number() OVER (ORDER BY seq) AS pos, CAST(passed AS INT)::DOUBLE AS value_b FROM b)
SELECT pos, value_a, value_b, value_b - value_a AS diff FROM x JOIN y USING (pos)""")
def positional_outcomes(spark, sf_dir):
    return trials.positional_pairs(trial_log(spark, sf_dir, "a"), trial_log(spark, sf_dir, "b"))


_STATS = """stats AS (
  SELECT x.lang, n_a, s_a, coalesce(n_b, 0) AS n_b, coalesce(s_b, 0) AS s_b, row_number() OVER (ORDER BY x.lang) - 1 AS idx
  FROM (SELECT lang, count(*) AS n_a, sum({0})::DOUBLE AS s_a FROM a GROUP BY lang) x
  LEFT JOIN (SELECT lang, count(*) AS n_b, sum({0})::DOUBLE AS s_b FROM b GROUP BY lang) y ON x.lang = y.lang)"""
STATS_SQL, STATS_SCORE_SQL = _STATS.format("CAST(passed AS INT)"), _STATS.format("score")
DRAWS_SQL = f"""draws AS (
  SELECT draw_id, sum(s_b) / sum(n_b) - sum(s_a) / sum(n_a) AS diff
  FROM (SELECT d.i AS draw_id, ('0x' || substr(md5('42|' || d.i || '|' || s.i), 1, 8))::BIGINT % (SELECT count(*) FROM stats) AS idx
        FROM range({N_BOOT}) d(i), range((SELECT count(*) FROM stats)) s(i)) JOIN stats USING (idx)
  GROUP BY draw_id)"""
CI_SQL = """SELECT round((SELECT avg({0}) FROM b) - (SELECT avg({0}) FROM a), 6) AS observed, round(quantile_cont(diff, 0.025::DOUBLE), 6) AS low,
 round(quantile_cont(diff, 0.975::DOUBLE), 6) AS high, (SELECT count(*) FROM stats) AS n_clusters, min(diff) = max(diff) AS degenerate FROM draws"""


def _both(spark, sf_dir):
    return trial_log(spark, sf_dir, "a"), trial_log(spark, sf_dir, "b")


@query(f"WITH {A_SQL}, {B_SQL}, {STATS_SQL} SELECT * FROM stats")
def cluster_sufficient_stats(spark, sf_dir):
    return trials.cluster_stats(*_both(spark, sf_dir), "lang")


@query(f"WITH {A_SQL}, {B_SQL}, {STATS_SQL}, {DRAWS_SQL} SELECT draw_id, round(diff, 6) AS diff FROM draws")
def bootstrap_draws(spark, sf_dir):
    return r6(resampling.bootstrap_draws(trials.cluster_stats(*_both(spark, sf_dir), "lang"), N_BOOT), "diff")


@query(f"WITH {A_SQL}, {B_SQL}, {STATS_SQL}, {DRAWS_SQL} {CI_SQL.format('CAST(passed AS INT)')}")
def cluster_bootstrap_ci(spark, sf_dir):
    return r6(resampling.cluster_bootstrap(*_both(spark, sf_dir), "lang", n_boot=N_BOOT), "observed", "low", "high")


@query(f"WITH {A_SQL}, {B_SQL}, {STATS_SCORE_SQL}, {DRAWS_SQL} {CI_SQL.format('score')}")
def cluster_bootstrap_ci_score(spark, sf_dir):
    return r6(resampling.cluster_bootstrap(*_both(spark, sf_dir), "lang", "score", N_BOOT), "observed", "low", "high")


def _pairs(spark, sf_dir):
    return trials.paired(*_both(spark, sf_dir))


#: Permutation p flips a pair if bit p % 32 of the md5 of seed, p // 32 and id is set.
PERM_SQL = f"""bits AS (SELECT b.i AS block, diff, ('0x' || substr(md5('42|' || b.i || '|' || id), 1, 8))::BIGINT AS bits FROM pairs, range({-(-N_PERM // 32)}) b(i) WHERE diff <> 0),
sums AS (SELECT block * 32 + k.i AS perm, sum(CASE WHEN (bits >> k.i) & 1 = 0 THEN diff ELSE -diff END) AS m FROM bits, range(32) k(i) WHERE block * 32 + k.i < {N_PERM} GROUP BY ALL),
perm AS (SELECT count(*) FILTER (abs(m) >= abs((SELECT sum(diff) FROM pairs))) AS exceed, round((count(*) FILTER (abs(m) >= abs((SELECT sum(diff) FROM pairs))) + 1) / {N_PERM + 1}.0::DOUBLE, 6) AS p_value FROM sums)"""


@query(f"WITH {PAIRS_SQL}, {PERM_SQL} SELECT (SELECT count(*) FROM pairs) AS n, round((SELECT avg(diff) FROM pairs), 6) AS observed, exceed, p_value FROM perm")
def permutation_test(spark, sf_dir):
    return r6(resampling.permutation_test(_pairs(spark, sf_dir), N_PERM), "observed", "p_value")


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT count(*) FILTER (diff > 0) AS up, count(*) FILTER (diff < 0) AS down FROM pairs)
SELECT up, down, round(least(1.0, (SELECT sum(CASE WHEN abs(2 * k.i - up - down) >= abs(up - down) THEN exp(lgamma(up + down + 1) - lgamma(greatest(k.i, 0) + 1) - lgamma(greatest(up + down - k.i, 0) + 1) - (up + down) * ln(2.0)) ELSE 0 END) FROM range((SELECT up + down + 1 FROM c)) k(i))), 6) AS p_value FROM c""")
def permutation_exact_binomial(spark, sf_dir):
    return r6(resampling.permutation_exact(_pairs(spark, sf_dir)), "p_value")


@query(f"WITH {PAIRS_SQL} SELECT count(*) AS n, round(stddev_pop(diff), 6) AS sd, round({Z!r}::DOUBLE * stddev_pop(diff) / sqrt(count(*)), 6) AS mde FROM pairs")
def mde(spark, sf_dir):
    return r6(resampling.detectable_effect(_pairs(spark, sf_dir)), "sd", "mde")


#: Each simulation draws 50 row numbers by Floyd's method.
SIMS_SQL = f"""numbered AS (SELECT diff, row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || id), 1, 8))::BIGINT, id) - 1 AS number FROM pairs),
drawn AS (
  SELECT s.i AS sim, 0 AS slot, []::BIGINT[] AS have FROM range({N_SIMS}) s(i)
  UNION ALL
  SELECT sim, slot + 1, list_append(have, CASE WHEN list_contains(have, t) THEN most ELSE t END)
  FROM (SELECT *, ('0x' || substr(md5('42|' || sim || '|' || slot), 1, 8))::BIGINT % (most + 1) AS t FROM (SELECT *, (SELECT count(*) FROM pairs) - 50 + slot AS most FROM drawn) WHERE slot < 50)),
sims AS (SELECT sim, avg(diff) AS diff FROM (SELECT sim, unnest(have) AS number FROM drawn WHERE slot = 50) JOIN numbered USING (number) GROUP BY sim)"""


@query(f"""WITH RECURSIVE {PAIRS_SQL}, {SIMS_SQL} SELECT round(avg(diff), 6) AS mean_diff, round(stddev_pop(diff), 6) AS sd_diff, round(min(diff), 6) AS min_diff, round(max(diff), 6) AS max_diff,
 round(quantile_cont(diff, 0.025::DOUBLE), 6) AS low, round(quantile_cont(diff, 0.975::DOUBLE), 6) AS high, round(avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END), 6) AS pick_b_rate FROM sims""")
def naive_subsample_sim(spark, sf_dir):
    return r6(resampling.subsample_simulation(_pairs(spark, sf_dir), 50, N_SIMS), "mean_diff", "sd_diff", "min_diff", "max_diff", "low", "high", "pick_b_rate")


@query(f"WITH RECURSIVE {PAIRS_SQL}, {SIMS_SQL} SELECT CASE WHEN diff > 0 THEN 'B' WHEN diff < 0 THEN 'A' ELSE 'Tie' END AS winner, count(*) AS n FROM sims GROUP BY ALL")
def winner_picks(spark, sf_dir):
    return resampling.subsample_means(_pairs(spark, sf_dir), 50, N_SIMS).groupBy("winner").agg(F.count("*").alias("n"))


REPORT_SQL = f"""WITH {PAIRS_SQL}, {PERM_SQL}, {STATS_SQL.replace('lang', 'task_family')}, {DRAWS_SQL}, ci AS (SELECT quantile_cont(diff, 0.025::DOUBLE) AS low, quantile_cont(diff, 0.975::DOUBLE) AS high FROM draws),
report AS (SELECT 'a' AS model, count(*) AS n, count(*) FILTER (passed) AS n_passed, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(score), 6) AS mean_score, NULL::DOUBLE AS delta, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, NULL::DOUBLE AS p_value, 'baseline' AS verdict FROM a
UNION ALL SELECT 'b', count(*), count(*) FILTER (passed), round(avg(CAST(passed AS INT)), 6), round(avg(score), 6), round(avg(CAST(passed AS INT)) - (SELECT avg(CAST(passed AS INT)) FROM a), 6), round((SELECT low FROM ci), 6), round((SELECT high FROM ci), 6), (SELECT p_value FROM perm),
 CASE WHEN (SELECT low FROM ci) > 0 THEN 'better' WHEN (SELECT high FROM ci) < 0 THEN 'worse' ELSE 'no difference shown' END FROM b)"""


@query(f"{REPORT_SQL} SELECT * FROM report")
def report(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return r6(report_rows({"a": a, "b": b}, "a"), "pass_rate", "mean_score", "delta", "ci_low", "ci_high", "p_value")


# ---- chat -----------------------------------------------------------------------------------------------------

_HEAD = f"'{chat.OPEN}system' || chr(10) || CASE WHEN first(role ORDER BY turn) = 'system' THEN first(text ORDER BY turn) ELSE '{chat.DEFAULT_SYSTEM}' END || '{chat.CLOSE}' || chr(10)"
_BODY = f"coalesce(string_agg('{chat.OPEN}' || role || chr(10) || text || '{chat.CLOSE}' || chr(10), '' ORDER BY turn) FILTER (role IN ('user', 'assistant') OR (role = 'system' AND place > 1)), '')"
RENDER_SQL = f"rendered AS (SELECT conv_id, {_HEAD} || {_BODY} AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) GROUP BY conv_id)"


def _rendered(spark, sf_dir, prompt=False):
    return chat.gather_messages(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("messages"), prompt).alias("text"))


@query(f"WITH {RENDER_SQL} SELECT * FROM rendered")
def chat_render(spark, sf_dir):
    return _rendered(spark, sf_dir)


@query(f"WITH {RENDER_SQL} SELECT conv_id, text || '{chat.OPEN}assistant' || chr(10) AS text FROM rendered")
def generation_prompt(spark, sf_dir):
    return _rendered(spark, sf_dir, True)


@query("SELECT role = 'system' AS has_system, count(*) AS n FROM (SELECT conv_id, first(role ORDER BY turn) AS role FROM conversations GROUP BY conv_id) GROUP BY ALL")
def chat_default_system(spark, sf_dir):
    m = chat.gather_messages(table(spark, sf_dir, "conversations"))
    return m.groupBy((F.get("messages", F.lit(0))["role"] == "system").alias("has_system")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) FILTER (role = 'user' AND before IS DISTINCT FROM 'user') AS n_blocks, count(*) FILTER (role = 'user') AS n_messages
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id""")
def tool_block_grouping(spark, sf_dir):
    """Neighbouring messages of a role share a block; user turns stand in for tool messages, which the tables lack."""
    m = chat.gather_messages(table(spark, sf_dir, "conversations"))
    tools = F.transform("messages", lambda x: F.struct(F.when(x["role"] == "user", "tool").otherwise(x["role"]).alias("role"), F.lit("").alias("content")))
    out = chat.render(tools)
    return m.select("conv_id", F.regexp_count(out, F.lit(r"user\n<tool_response>|user\r?\n?\n<tool_response>")).cast("long").alias("n_blocks"), F.regexp_count(out, F.lit("<tool_response>")).cast("long").alias("n_messages"))


_MARK = f"'{chat.OPEN}assistant' || chr(10)"


@query(f"WITH {RENDER_SQL} SELECT conv_id, CASE WHEN strpos(text, {_MARK}) > 0 THEN strpos(text, {_MARK}) - 1 + {len(chat.RESPONSE_MARK)} ELSE -1 END AS response_start, strpos(text, {_MARK}) > 0 AS mask_found FROM rendered")
def response_mask_span(spark, sf_dir):
    start = chat.response_start(F.col("text"))
    return _rendered(spark, sf_dir).select("conv_id", start.cast("long").alias("response_start"), (start >= 0).alias("mask_found"))


def _ids(column="text"):
    return F.transform(F.filter(F.split(column, r"[ \n]"), lambda w: w != ""), lambda w: F.length(w))


@query("""WITH t AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '[ \\n]'), lambda w: w <> ''), lambda w: len(w))[1:1024] AS ids FROM documents),
p AS (SELECT doc_id, ids, coalesce(list_min(list_filter(range(1, len(ids)), lambda i: ids[i] = 3 AND ids[i + 1] = 2)), 0) AS pos FROM t)
SELECT doc_id, len(ids) AS n, pos > 0 AS mask_found, list_sum(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN pos > 0 AND i <= pos + 1 THEN -100 ELSE ids[i] END))::BIGINT AS label_sum,
 len(list_filter(range(1, len(ids) + 1), lambda i: pos > 0 AND i <= pos + 1)) AS n_masked FROM p WHERE len(ids) > 0""")
def label_mask_tokens(spark, sf_dir):
    template = F.array(F.lit(3), F.lit(2))

    def figures(ids, labels):
        total = F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x)
        masked = F.size(F.filter(labels, lambda x: x == chat.IGNORED)).cast("long")
        return F.struct(F.size(ids).cast("long").alias("n"), (chat.template_end(ids, template) > 0).alias("mask_found"), total.alias("label_sum"), masked.alias("n_masked"))

    row = chat.bound(chat.truncate(_ids()), lambda ids: chat.bound(chat.mask_labels(ids, template), lambda labels: figures(ids, labels)))
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^ \n]")).select("doc_id", row.alias("row")).select("doc_id", "row.*")


@query("""WITH t AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '[ \\n]'), lambda w: w <> ''), lambda w: len(w))[1:64] AS ids FROM conversations),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS most FROM t)
SELECT conv_id, turn, most AS n, most - len(ids) AS n_pad, coalesce(list_sum(ids), 0)::BIGINT AS total, CASE WHEN len(ids) = most THEN false ELSE true END AS starts_with_pad FROM m""")
def truncate_pad(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.truncate(_ids(), 64).alias("ids"))
    rows = rows.withColumn("most", F.max(F.size("ids")).over(Window.partitionBy("conv_id")))
    left, right = chat.pad(F.col("ids"), F.col("most"), -1, "left"), chat.pad(F.col("ids"), F.col("most"), 0)
    return rows.select(
        "conv_id", "turn", F.size(right).cast("long").alias("n"), F.size(F.filter(left, lambda x: x == -1)).cast("long").alias("n_pad"),
        F.aggregate(right, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.coalesce(F.get(left, F.lit(0)) == -1, F.lit(False)).alias("starts_with_pad"),
    )


# ---- records --------------------------------------------------------------------------------------------------

_CODE = f"'```python' || chr(10) || {{0}} || chr(10) || '```'"


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("task_family"), "lang", F.col("text").alias("prompt"), F.col("text").alias("code"), "n_chars")


@query(f"""SELECT lang || '_' || printf('%05d', row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id, source AS task_family, {_CODE.format('text')} AS answer, n_chars::INT AS num_trials FROM documents""")
def sft_records(spark, sf_dir):
    rows = records.numbered(_documents(spark, sf_dir), "", "seq", "lang")
    rows = rows.withColumns({"complexity": F.lit("simple"), "constraint_types": F.array(F.lit("crossing")), "num_trials": F.col("n_chars"), "num_factors": F.lit(2), "exec_time_sec": F.lit(0.0)})
    return records.sft_records(rows).select("id", "task_family", F.col("messages")[2]["content"].alias("answer"), F.col("meta.num_trials").alias("num_trials"))


def _graded(spark, sf_dir):
    docs = _documents(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "seq"), "seq")
    return docs.select("seq", "task_family", "prompt", F.col("code").alias("canonical_code"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("```\n"), "prompt")).otherwise(F.col("prompt")).alias("completion"), (F.col("quality") == 1).alias("passed"), F.lit("ValueError: x").alias("error"))


PAIR_ROWS_SQL = f"""pair_rows AS (
  SELECT 'dpo_' || printf('%05d', row_number() OVER (ORDER BY d.doc_id) - 1) AS id, source AS task_family, text AS prompt, {_CODE.format('text')} AS chosen,
         CASE WHEN d.doc_id % 2 = 0 THEN '```' || chr(10) || text WHEN starts_with(text, '```') THEN text ELSE {_CODE.format('text')} END AS rejected
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality <> 1)"""


@query(f"WITH {PAIR_ROWS_SQL} SELECT *, 'ValueError: x' AS rejected_error FROM pair_rows")
def preference_pairs(spark, sf_dir):
    p = records.preference_pairs(_graded(spark, sf_dir))
    return p.select("id", "task_family", "prompt", F.col("chosen")[2]["content"].alias("chosen"), F.col("rejected")[2]["content"].alias("rejected"), "rejected_error")


@query(f"""WITH {PAIR_ROWS_SQL} SELECT '{chat.OPEN}system' || chr(10) || '{synthesis.SYSTEM}' || '{chat.CLOSE}' || chr(10) || '{chat.OPEN}user' || chr(10) || prompt || '{chat.CLOSE}' || chr(10) || '{chat.OPEN}assistant' || chr(10) AS prompt,
 chosen || '{chat.CLOSE}' AS chosen, rejected || '{chat.CLOSE}' AS rejected FROM pair_rows""")
def dpo_text(spark, sf_dir):
    return chat.preference_text(records.preference_pairs(_graded(spark, sf_dir)))


@query("SELECT doc_id AS seq, source AS task_family FROM documents ORDER BY doc_id LIMIT 100")
def split_first_n(spark, sf_dir):
    return records.first_n(_documents(spark, sf_dir).select("seq", "task_family"), 100)


@query("SELECT doc_id AS seq, doc_id // 16 AS batch, doc_id % 16 AS slot FROM documents")
def batch_keys(spark, sf_dir):
    return records.batches(_documents(spark, sf_dir).select("seq"))


@query("SELECT 'train' AS split, doc_id AS seq FROM documents WHERE doc_id % 10 < 8 UNION ALL SELECT 'val', doc_id FROM documents WHERE doc_id % 10 = 8 UNION ALL SELECT 'test', doc_id FROM documents WHERE doc_id % 10 = 9")
def split_union(spark, sf_dir):
    d = _documents(spark, sf_dir).select("seq")
    k = F.col("seq") % 10
    return records.union_splits(train=d.where(k < 8), val=d.where(k == 8), test=d.where(k == 9))


@query("SELECT doc_id AS seq, text AS prompt FROM documents WHERE doc_id % 5 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)")
def train_test_overlap(spark, sf_dir):
    d = _documents(spark, sf_dir).select("seq", "prompt")
    return records.train_test_overlap(d.where(F.col("seq") % 5 != 0), d.where(F.col("seq") % 5 == 0)).select("seq", "prompt")


# ---- code -----------------------------------------------------------------------------------------------------


@query(f"""WITH {COMPLETIONS_SQL}, f AS (SELECT doc_id, completion, regexp_extract_all(completion, '(?is)```(?:python)?\\s*(.*?)\\s*```', 1) AS found FROM completions)
SELECT doc_id, regexp_replace(CASE WHEN len(found) > 0 THEN found[-1] ELSE completion END, '^\\s+|\\s+$', '', 'g') AS code FROM f""")
def extract_code(spark, sf_dir):
    return completions(spark, sf_dir).select("doc_id", text.extract_code(F.col("completion")).alias("code"))


@query()
def ast_check(spark, sf_dir):
    return grading.ast_checks(completions(spark, sf_dir).select("doc_id", text.extract_code(F.col("completion")).alias("code")), module="itertools").drop("code")


#: A program for each step of the ladder.
PROGRAMS = {"syntax": "x==", "crash": "import sys; sys.exit(1)", "raised": "1/0", "nothing": "x=1", "passed": 'experiments=[{"a":[1,2],"b":[3,4]}]'}


@query("""SELECT o.outcome, o.score::DOUBLE AS score, o.error_type, o.passed, o.num_trials::INT AS num_trials, o.num_factors::INT AS num_factors FROM (VALUES
 ('syntax', 0.0, 'SyntaxError', false, 0, 0), ('crash', 0.2, 'SubprocessCrash', false, 0, 0), ('raised', 0.3, 'ZeroDivisionError', false, 0, 0), ('nothing', 0.4, 'NoExperimentsProduced', false, 0, 0), ('passed', 1.0, NULL, true, 2, 2)) o(outcome, score, error_type, passed, num_trials, num_factors)""")
def sandbox_grade(spark, sf_dir):
    rows = spark.createDataFrame(list(PROGRAMS.items()), "outcome string, code string").repartition(len(PROGRAMS))
    return grading.grade(rows, timeout=20.0).select("outcome", "grade.score", "grade.error_type", "grade.passed", "grade.num_trials", "grade.num_factors")


@query("""SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def last_json_line(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = F.concat(F.lit('start\n{"k": -1}\n{broken}\n'), "props", F.lit("\nend"))
    return e.select("event_id", text.last_json_line(out, "k bigint")["k"].alias("k"))


@query(f"WITH {B_SQL} SELECT id, CASE WHEN passed THEN 1.0 ELSE ([0.0, 0.1, 0.2, 0.3, 0.4, 0.6])[CAST(seq % 6 + 1 AS INT)] END::DOUBLE AS score FROM b")
def reward_ladder(spark, sf_dir):
    outcome = F.element_at(F.array(*map(F.lit, ("syntax", "timeout", "crash", "raised", "nothing", "synthesis"))), (F.col("seq") % 6 + 1).cast("int"))
    return trial_log(spark, sf_dir).select("id", grading.ladder_score(F.when(F.col("passed"), "passed").otherwise(outcome)).alias("score"))


# ---- synthesis ------------------------------------------------------------------------------------------------

N_ATTEMPTS = 500


def _h(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(["'42'", *parts]) + "), 1, 8))::BIGINT"


def _sql_pick(values: list, part: str) -> str:
    return f"({values})[CAST({_h('a', repr(part))} % {len(values)} + 1 AS INT)]"


def _generated(generator):
    def run(spark, sf_dir):
        return generator(synthesis.attempts(spark, N_ATTEMPTS)).select("attempt", "task_family", "complexity", F.array_join("constraint_types", ",").alias("constraint_types"), "prompt", "code")

    return run


_RANGE = f"r AS (SELECT i AS a FROM range({N_ATTEMPTS}) t(i))"
_FACTORS = [{"name": n, "levels": v} for n, v in [*synthesis.PERCEPTUAL.items(), *synthesis.COGNITIVE.items()]]
_LIST = "'[''' || array_to_string({0}, ''', ''') || ''']'"


def _filled(template: str, **values: str) -> str:
    """SQL that replaces each name in braces by an expression's value."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_LINES = f"string_agg('    (''' || name || ''', ' || {_LIST.format('picked')} || '),', chr(10) ORDER BY r)"
_CONGRUENT = (
    "CASE WHEN name = 'stroop' THEN '[''red'', ''green'', ''blue'', ''yellow'']' ELSE '[''left'', ''right'']' END",
    "CASE name WHEN 'stroop' THEN 'word_text' WHEN 'flanker' THEN 'target_direction' ELSE 'stimulus_location' END",
    "CASE name WHEN 'stroop' THEN 'font_color' WHEN 'flanker' THEN 'flanker_direction' ELSE 'response_hand' END",
)


@query(f"""WITH {_RANGE}, f AS (SELECT unnest({_FACTORS}) AS f, unnest(range(23)) AS i),
c AS (SELECT a, f.name AS name, f.levels AS levels, row_number() OVER (PARTITION BY a ORDER BY {_h('a', "'f'", 'i')}, i) AS r FROM r, f),
d AS (SELECT *, 2 + {_h('a', "'k'", 'name')} % least(3, len(levels) - 1) AS k FROM c WHERE r <= 2 + {_h('a', "'n'")} % 3),
l AS (SELECT a, r, name, k, levels[j.i + 1] AS level, row_number() OVER (PARTITION BY a, name ORDER BY {_h('a', "'l'", 'name', 'j.i')}, j.i) AS q FROM d, range(4) j(i) WHERE j.i < len(levels)),
g AS (SELECT a, r, name, list(level ORDER BY q) AS picked FROM l WHERE q <= k GROUP BY a, r, name),
t AS (SELECT a, count(*) AS n, {_LINES} AS lines, string_agg('''' || name || ''' with levels ' || {_LIST.format('picked')}, ', ' ORDER BY r) AS told FROM g GROUP BY a),
u AS (SELECT *, CASE WHEN {_h('a', "'m'")} % 10 < 4 THEN ([16, 24, 32, 48])[CAST({_h('a', "'t'")} % 4 + 1 AS INT)] ELSE 0 END AS least FROM t),
v AS (SELECT *, CASE WHEN least > 0 THEN ' Run at least ' || least || ' trials.' ELSE '' END AS asked FROM u)
SELECT a AS attempt, 'factorial_crossing' AS task_family, CASE WHEN n = 2 THEN 'simple' ELSE 'medium' END AS complexity, CASE WHEN least > 0 THEN 'crossing,minimum_trials' ELSE 'crossing' END AS constraint_types,
 CASE {_h('a', "'p'")} % 3 WHEN 0 THEN 'Create an experiment that fully crosses ' || told || '.' || asked WHEN 1 THEN 'Write a script for a factorial design over ' || n || ' factors: ' || told || '.' || asked
  ELSE 'Cross every level of ' || told || ' and list the trials.' || asked END AS prompt, {_filled(synthesis.CROSSING, lines='lines', least='least::VARCHAR')} AS code FROM v""")
def synth_factorial(spark, sf_dir):
    return _generated(synthesis.factorial)(spark, sf_dir)


@query(f"""WITH {_RANGE}, n AS (SELECT a, {_sql_pick(["stroop", "flanker", "simon"], "c")} AS name, CASE WHEN {_h('a', "'m'")} % 10 < 6 THEN {_sql_pick([1, 2], "k")} ELSE 0 END AS k FROM r)
SELECT a AS attempt, {_filled(synthesis.CONGRUENCY, levels=_CONGRUENT[0], first=_CONGRUENT[1], second=_CONGRUENT[2])} AS code, CASE WHEN name = 'stroop' THEN 'stroop_congruency' ELSE 'flanker_task' END AS task_family, 'medium' AS complexity, CASE WHEN k > 0 THEN 'within_trial_derivation,at_most_k_in_a_row' ELSE 'within_trial_derivation' END AS constraint_types,
 CASE WHEN {_h('a', "'p'")} % 2 = 0 THEN 'Build a ' ELSE 'Write the trials of a ' END || name || ' task: cross ''' || CASE name WHEN 'stroop' THEN 'word_text' WHEN 'flanker' THEN 'target_direction' ELSE 'stimulus_location' END || ''' and ''' ||
 CASE name WHEN 'stroop' THEN 'font_color' WHEN 'flanker' THEN 'flanker_direction' ELSE 'response_hand' END || ''' over ' || CASE WHEN name = 'stroop' THEN '[''red'', ''green'', ''blue'', ''yellow'']' ELSE '[''left'', ''right'']' END || ' and mark congruent trials.' ||
 CASE WHEN k > 0 THEN ' No more than ' || k || ' congruent trials in a row.' ELSE '' END AS prompt FROM n""")
def synth_congruency(spark, sf_dir):
    return _generated(synthesis.congruency)(spark, sf_dir)


@query(f"""WITH {_RANGE}, n AS (SELECT a, {_sql_pick(synthesis.TASKS, "a")} AS t, ({[{"name": n, "levels": v} for n, v in synthesis.STIMULI]})[CAST({_h('a', "'s'")} % 3 + 1 AS INT)] AS s FROM r)
SELECT a AS attempt, 'task_switching_transition' AS task_family, 'complex' AS complexity, 'transition_derivation,at_most_k_in_a_row,minimum_trials' AS constraint_types,
 'Design a task-switching experiment: tasks ' || {_LIST.format('t')} || ', ''' || s.name || ''' with levels ' || {_LIST.format('s.levels')} || '. Derive repeat and switch from the task before. At most ' || {_sql_pick([2, 3], "r")} || ' repeats in a row, at least ' || {_sql_pick([8, 12, 16], "t")} || ' trials.' AS prompt,
 {_filled(synthesis.SWITCHING, tasks=_LIST.format('t'), levels=_LIST.format('s.levels'), least=_sql_pick([8, 12, 16], "t") + '::VARCHAR', stimulus='s.name')} AS code FROM n""")
def synth_task_switching(spark, sf_dir):
    return _generated(synthesis.task_switching)(spark, sf_dir)


@query(f"""WITH {_RANGE} SELECT a AS attempt, 'nback_window' AS task_family, 'complex' AS complexity, 'window_derivation,minimum_trials' AS constraint_types,
 'Write a ' || {_sql_pick([1, 2], "n")} || '-back task over the letters [''A'', ''B'', ''C''] with at least ' || {_sql_pick([12, 18], "t")} || ' trials, and mark targets.' AS prompt,
 {_filled(synthesis.NBACK, n=_sql_pick([1, 2], "n") + '::VARCHAR', least=_sql_pick([12, 18], "t") + '::VARCHAR')} AS code FROM r""")
def synth_nback(spark, sf_dir):
    return _generated(synthesis.nback)(spark, sf_dir)


@query(f"""WITH {_RANGE} SELECT a AS attempt, 'constrained_design' AS task_family, 'medium' AS complexity, 'exclude,pin,at_most_k_in_a_row' AS constraint_types,
 'Cross ''modality'' (visual, auditory, tactile) with ''intensity'' (low, medium, high), leave out ' || {_sql_pick(["visual", "auditory", "tactile"], "x")} || ', and start with intensity ' || {_sql_pick(["low", "medium", "high"], "p")} || '.' AS prompt,
 {_filled(synthesis.CONSTRAINED, gone=_sql_pick(["visual", "auditory", "tactile"], "x"), pin=_sql_pick(["low", "medium", "high"], "p"))} AS code FROM r""")
def synth_constrained(spark, sf_dir):
    return _generated(synthesis.constrained)(spark, sf_dir)


_PERCEPTUAL = [{"name": n, "levels": v} for n, v in synthesis.PERCEPTUAL.items()]
_COGNITIVE = [{"name": n, "levels": v} for n, v in synthesis.COGNITIVE.items()]


def _two(source: str, part: str) -> str:
    return f"""(SELECT a, r, name, list(level ORDER BY q) AS picked FROM (SELECT a, r, name, levels[j.i + 1] AS level, row_number() OVER (PARTITION BY a, name ORDER BY {_h('a', repr(part), 'name', 'j.i')}, j.i) AS q FROM {source}, range(4) j(i) WHERE j.i < len(levels)) WHERE q <= 2 GROUP BY a, r, name)"""


@query(f"""WITH {_RANGE}, p AS (SELECT unnest({_PERCEPTUAL}) AS f, unnest(range(8)) AS i), g AS (SELECT unnest({_COGNITIVE}) AS f, unnest(range(15)) AS i),
pc AS (SELECT * FROM (SELECT a, f.name AS name, f.levels AS levels, row_number() OVER (PARTITION BY a ORDER BY {_h('a', "'f'", 'i')}, i) AS r FROM r, p) WHERE r <= 2),
gc AS (SELECT * FROM (SELECT a, f.name AS name, f.levels AS levels, row_number() OVER (PARTITION BY a ORDER BY {_h('a', "'g'", 'i')}, i) AS r FROM r, g) WHERE r <= 1),
x AS (SELECT a, {_LINES} AS lines, string_agg('''' || name || ''' with levels ' || {_LIST.format('picked')}, ', ' ORDER BY r) AS told FROM {_two('pc', 'l')} GROUP BY a),
y AS (SELECT a, '''' || name || ''' with levels ' || {_LIST.format('picked')} AS free, name AS factor, {_LIST.format('picked')} AS free_levels FROM {_two('gc', 'm')})
SELECT a AS attempt, 'partial_crossing' AS task_family, 'medium' AS complexity, 'partial_crossing,at_most_k_in_a_row' AS constraint_types, 'Cross ' || told || '; vary ' || free || ' without crossing it.' AS prompt,
 {_filled(synthesis.PARTIAL, lines='lines', least="'0'", free='free_levels', factor='factor')} AS code FROM x JOIN y USING (a)""")
def synth_partial(spark, sf_dir):
    return _generated(synthesis.partial)(spark, sf_dir)


@query(f"""WITH r AS (SELECT i AS a FROM range({N_ATTEMPTS}) t(i)), ok AS (SELECT a, {_h('a', "'generator'")} % 6 AS g FROM r WHERE {_h('a', "'ok'")} % 10 < 7)
SELECT 'train_' || printf('%05d', row_number() OVER (ORDER BY a) - 1) AS id, a AS attempt, g AS generator FROM ok ORDER BY a LIMIT 200""")
def rejection_sample(spark, sf_dir):
    rows = synthesis.attempts(spark, N_ATTEMPTS).withColumn("generator", draw(6, 42, F.col("attempt"), "generator"))
    return synthesis.first_accepted(rows.withColumn("ok", draw(10, 42, F.col("attempt"), "ok") < 7), 200, "train").select("id", "attempt", "generator")


# ---- designs --------------------------------------------------------------------------------------------------


@query(f"""WITH {DESIGNS_SQL}, l AS (SELECT * FROM (SELECT DISTINCT kind FROM designs), (SELECT DISTINCT band FROM designs)), g AS (SELECT * FROM (SELECT DISTINCT design_id FROM designs), l WHERE NOT (kind = 'error' AND band = 'high'))
SELECT g.design_id, g.kind, g.band, count(d.event_id) AS n FROM g LEFT JOIN designs d USING (design_id, kind, band) GROUP BY ALL""")
def design_crossing(spark, sf_dir):
    d = designs(spark, sf_dir)
    levels = d.select("kind").distinct().crossJoin(d.select("band").distinct())  # full crossing of two factors' levels
    return design.crossing_counts(d, ["kind", "band"], levels, (F.col("kind") == "error") & (F.col("band") == "high"))


@query(f"""WITH {DESIGNS_SQL}, g AS (SELECT *, trial_idx - row_number() OVER (PARTITION BY design_id, kind ORDER BY trial_idx) AS k FROM designs), runs AS (SELECT design_id, kind, count(*) AS run_length FROM g GROUP BY design_id, kind, k)
SELECT design_id, coalesce(max(run_length) FILTER (kind = 'click'), 0) AS longest, coalesce(max(run_length) FILTER (kind = 'click'), 0) <= 2 AS ok FROM runs GROUP BY design_id""")
def design_run_lengths(spark, sf_dir):
    return design.at_most_in_a_row(designs(spark, sf_dir), "kind", "click", 2)


def _back_sql(n: int, name: str, yes: str, no: str) -> str:
    return f"WITH {DESIGNS_SQL} SELECT event_id, CASE WHEN trial_idx > {n} THEN CASE WHEN lag(kind, {n}) OVER (PARTITION BY design_id ORDER BY trial_idx) IS NOT DISTINCT FROM kind THEN '{yes}' ELSE '{no}' END END AS {name} FROM designs"


@query(_back_sql(1, "transition", "repeat", "switch"))
def design_transition(spark, sf_dir):
    return design.transition(designs(spark, sf_dir), "kind").select("event_id", "transition")


@query(_back_sql(2, "target", "target", "lure"))
def design_nback(spark, sf_dir):
    return design.back(designs(spark, sf_dir), "kind", 2).select("event_id", "target")


@query("""WITH e AS (SELECT user_id, event_type, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS band, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id AS design_id, count(*) FILTER (event_type = 'error') AS n_excluded, coalesce(max(CASE WHEN i = 1 THEN CAST(band = 'low' AS INT) END), 0) = 1 AS pin_ok FROM e GROUP BY user_id""")
def design_exclude_pin(spark, sf_dir):
    from pyspark.sql import Window

    d = designs(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("design_id").orderBy("trial_idx")))
    return design.exclude_and_pin(d, "kind", "error", "band", "low", 1, place="i")


@query("SELECT user_id AS design_id, count(*) AS n, count(*) >= 10 AS ok FROM events GROUP BY user_id")
def design_min_trials(spark, sf_dir):
    return design.minimum_trials(designs(spark, sf_dir), 10)


@query("SELECT CASE WHEN l_returnflag = l_linestatus THEN 'congruent' ELSE 'incongruent' END AS congruency, count(*) AS n FROM lineitem GROUP BY ALL")
def within_trial_congruency(spark, sf_dir):
    d = design.within_trial(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")
    return d.groupBy("congruency").agg(F.count("*").alias("n"))


# ---- files ----------------------------------------------------------------------------------------------------


@query("SELECT record_kind, n FROM (VALUES ('train', 2::BIGINT), ('eval', 1::BIGINT), ('final', 1::BIGINT)) t(record_kind, n)")
def train_log_kinds(spark, sf_dir):
    """A log of three kinds of rows, written as JSON and read back by the log's schema."""
    rows = [(0.1, 5, 1.5, None, None), (0.2, 10, 1.1, None, None), (0.2, 10, None, 0.9, None), (0.3, 15, None, None, 12.5)]
    path = shared_path(spark, "train-log") + ".json"
    files.write_train_log(spark.createDataFrame(rows, "epoch double, step bigint, loss double, eval_loss double, train_runtime double"), path)
    return files.read_train_log(spark, path).groupBy("record_kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, text FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, one_file=False)
    return files.read_jsonl(spark, path, "doc_id bigint, source string, text string")


# The other modules enter their queries as they are imported; some need SQL that is made above.
from . import catalogue_code, catalogue_files  # noqa: E402

catalogue_files.attach(REPORT_SQL)
catalogue_code.attach()

__all__ = ["ORACLE", "QUERIES"]
