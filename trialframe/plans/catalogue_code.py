"""Queries of grading, evaluation, preference pairs, tokens and tool calls, beside those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, tokens
from ..operators import grading
from ..operators.completion import LookupCompleter
from ..operators.records import message
from . import evaluation
from .proxy import table
from .registry import query

GOOD = 'experiments=[{"a":[1,2],"b":[3,4]}]'
#: Programs for every outcome: name, code, whether a module is asked for that isn't there, and what the grader says.
OUTCOMES = [
    ("syntax", "x==", 0.0, "SyntaxError", False, False, 0, 0), ("import", GOOD, 0.1, "ImportError", True, False, 0, 0),
    ("timeout", "while True: pass", 0.1, "TimeoutExpired", True, False, 0, 0), ("crash", "import sys; sys.exit(1)", 0.2, "SubprocessCrash", True, False, 0, 0),
    ("raised", "1/0", 0.3, "ZeroDivisionError", True, False, 0, 0), ("nothing", "x=1", 0.4, "NoExperimentsProduced", True, False, 0, 0),
    ("block_only", "class Block: pass\nb = Block()", 0.6, "SynthesisError_TypeError", True, False, 0, 0),
    ("block", "class Block:\n    def __mul__(self, n): return [{'a': [1, 2, 3]}] * n\nb = Block()", 1.0, None, True, True, 3, 1),
    ("other_name", "class Other: pass\nfirst = [{'x': [1]}]\nlast = [{'a': [1, 2], 'b': [3, 4], 'c': [5, 6]}]", 1.0, None, True, True, 2, 3),
    ("passed", GOOD, 1.0, None, True, True, 2, 2),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _values(rows: list[tuple], names: str, kinds: str) -> str:
    """SQL of a table of literals, cast to ``kinds``."""
    body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names.split(), kinds.split()))
    return f"SELECT {cast} FROM (VALUES {body}) t({', '.join(names.split())})"


@query(_values([(n, s, e, v, p, t, f) for n, _, s, e, v, p, t, f in OUTCOMES], "outcome score error_type syntax_valid passed num_trials num_factors", "VARCHAR DOUBLE VARCHAR BOOLEAN BOOLEAN INT INT"))
def sandbox_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the ladder, under a dialect with a block class and a function that makes experiments of one."""
    dialect, missing = grading.Dialect("operator", block="Block", synthesize="mul"), grading.Dialect("no_such_module")
    rows = spark.createDataFrame([(o[0], o[1]) for o in OUTCOMES], "outcome string, code string")
    late, others = F.col("outcome") == "timeout", ~F.col("outcome").isin("timeout", "import")
    parts = [
        grading.grade(rows.where(others), timeout=20.0, dialect=dialect, tasks=4), grading.grade(rows.where(late), timeout=1.0, dialect=dialect),
        grading.grade(rows.where(F.col("outcome") == "import"), timeout=20.0, dialect=missing),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("outcome", "grade.score", "grade.error_type", "grade.syntax_valid", "grade.passed", "grade.num_trials", "grade.num_factors")


AST_PROGRAMS = [
    ("plain import", "import itertools as i", True, True, False), ("from import", "def f():\n    from itertools.x import y", True, True, False), ("part of a name", "import my_itertools.z", True, True, False),
    ("no import", "x = 'itertools'", True, False, False), ("bad syntax", "def f(:", False, False, True), ("relative", "from . import x", True, False, False), ("empty", "", True, False, False), ("null byte", "x\0", False, False, True),
]


@query(_values([(n, a, b, c) for n, _, a, b, c in AST_PROGRAMS], "name syntax_ok imports_target has_error", "VARCHAR BOOLEAN BOOLEAN BOOLEAN"))
def ast_outcomes(spark, sf_dir):
    rows = spark.createDataFrame([(n, code) for n, code, *_ in AST_PROGRAMS], "name string, code string")
    return grading.ast_checks(rows, module="itertools").select("name", "syntax_ok", "imports_target", F.col("syntax_error").isNotNull().alias("has_error"))


#: Items of a small evaluation: prompt, family, complexity (null is unknown), what the model answers.
ITEMS = [
    ("p0", "stroop_congruency", "simple", f"```python\n{GOOD}\n```"), ("p1", "stroop_congruency", None, "no code"), ("p2", None, "simple", "```\n1/0\n```"),
    ("p3", "nback_window", "complex", "```python\nx = 1\n```"), ("p4", "nback_window", "complex", f"Sure:\n```PYTHON\n{GOOD}\n```\nDone."), ("p5", "factorial_crossing", "medium", "raise KeyError('k')"),
]


def _records(spark) -> DataFrame:
    rows = spark.createDataFrame([(i, f"test_{i:05d}", f, c, p) for i, (p, f, c, _) in enumerate(ITEMS)], "seq long, id string, task_family string, complexity string, prompt string")
    said = F.array(message("system", F.lit("Be brief.")), message("user", F.col("prompt")), message("assistant", F.lit(GOOD)))
    return rows.withColumns({"messages": said, "canonical_code": F.lit(GOOD)})


def _model():
    asked = lambda p: f"{chat.OPEN}system\nBe brief.{chat.CLOSE}\n{chat.OPEN}user\n{p}{chat.CLOSE}\n{chat.RESPONSE_MARK}"
    return LookupCompleter({asked(p): answer for p, _, _, answer in ITEMS}, "?")


_VERDICTS = [(True, 1.0, None, 2), (False, 0.0, "SyntaxError", 0), (False, 0.3, "ZeroDivisionError", 0), (False, 0.4, "NoExperimentsProduced", 0), (True, 1.0, None, 2), (False, 0.3, "KeyError", 0)]


@query(_values([(f"test_{i:05d}", f or "unknown", c or "unknown", p, a, *v) for i, ((p, f, c, a), v) in enumerate(zip(ITEMS, _VERDICTS))],
    "id task_family complexity prompt generated_completion passed score error_type num_trials", "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN DOUBLE VARCHAR INT"))
def graded_trials(spark, sf_dir):
    """Trial records: completions graded, families and complexities that miss named unknown."""
    done = evaluation.complete(evaluation.generation_prompt(_records(spark)), _model)
    out = grading.grade_completions(done, timeout=20.0, tasks=4)
    return out.select("id", "task_family", "complexity", "prompt", "generated_completion", "passed", "score", "error_type", "num_trials")


@query(_values([
    ("overall", "", 6, 2, 0.5), ("timed", "", 6, 0, 0.0), ("family", "stroop_congruency", 2, 1, 0.5), ("family", "unknown", 1, 0, 0.3), ("family", "nback_window", 2, 1, 0.7), ("family", "factorial_crossing", 1, 0, 0.3),
    ("error", "SyntaxError", 1, 0, 0.0), ("error", "ZeroDivisionError", 1, 0, 0.0), ("error", "NoExperimentsProduced", 1, 0, 0.0), ("error", "KeyError", 1, 0, 0.0),
], "entry name n n_passed mean_score", "VARCHAR VARCHAR BIGINT BIGINT DOUBLE"))
def checkpoint_evaluation(spark, sf_dir):
    """A checkpoint's whole evaluation, its summary a row for each entry; ``timed`` is there if all its times are above 0."""
    trials, summary = evaluation.evaluate_checkpoint(_records(spark), _model, batch_size=4, timeout=20.0, tasks=4)
    s = evaluation.with_throughput(summary)
    none, n = F.lit(0).cast("long"), F.col("num_eval_samples")
    timed = F.least("total_eval_time_sec", "generation_time_sec", "grading_time_sec", "generation_per_sec", "grading_per_sec", "total_eval_per_sec") > 0
    out = s.select(F.lit("overall").alias("entry"), F.lit("").alias("name"), n.alias("n"), F.round(n * F.col("pass_rate_pass_at_1")).cast("long").alias("n_passed"), F.round("mean_stepped_score", 6).alias("mean_score"))
    out = out.unionByName(s.where(timed & (F.col("total_eval_time_sec") >= F.col("grading_time_sec"))).select(F.lit("timed").alias("entry"), F.lit("").alias("name"), n.alias("n"), none.alias("n_passed"), F.lit(0.0).alias("mean_score")))
    family = s.select(F.explode("family_breakdown").alias("name", "v")).select(F.lit("family").alias("entry"), "name", F.col("v.n").alias("n"), F.round(F.col("v.n") * F.col("v.pass_rate")).cast("long").alias("n_passed"), F.round("v.mean_score", 6).alias("mean_score"))
    error = s.select(F.explode("error_distribution").alias("name", "n")).select(F.lit("error").alias("entry"), "name", "n", none.alias("n_passed"), F.lit(0.0).alias("mean_score"))
    return out.unionByName(family).unionByName(error)


_REJECTED = [(1, "stroop_congruency", "```python\nno code\n```", "SyntaxError"), (2, "unknown", "```\n1/0\n```", "ZeroDivisionError: division by zero"), (3, "nback_window", "```python\nx = 1\n```", "NoExperimentsSynthesized"), (5, "factorial_crossing", "```python\nraise KeyError('k')\n```", "KeyError: 'k'")]


@query(_values([(f"dpo_{n:05d}", f, ITEMS[i][0], "Be brief.", f"```python\n{GOOD}\n```", r, e) for n, (i, f, r, e) in enumerate(_REJECTED)], "id task_family prompt system chosen rejected rejected_error", "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR"))
def pair_builder(spark, sf_dir):
    """Complete, run, keep failures: a syntax error's message is the parser's, so only its type is compared."""
    p = evaluation.build_pairs(_records(spark), _model, timeout=20.0, tasks=4)
    error = F.when(F.startswith("rejected_error", F.lit("SyntaxError: ")), "SyntaxError").otherwise(F.col("rejected_error"))
    return p.select("id", "task_family", "prompt", F.col("rejected")[0]["content"].alias("system"), F.col("chosen")[2]["content"].alias("chosen"), F.col("rejected")[2]["content"].alias("rejected"), error.alias("rejected_error"))


# ---- tokens ---------------------------------------------------------------------------------------------------


class CodePointTokenizer:
    """A token for each character, in a worker; ``tokens.code_points`` is the same without one."""

    def encode(self, text: str) -> list[int]:
        return list(map(ord, text))

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


@query("SELECT conv_id, turn, len(text) AS n, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))), 0)::BIGINT AS total, true AS alike, text AS decoded FROM conversations")
def tokenize_turns(spark, sf_dir):
    """Any tokenizer by way of workers, here that of code points, which must agree with the built-in one."""
    rows = tokens.tokenize(table(spark, sf_dir, "conversations"), CodePointTokenizer)
    rows = tokens.detokenize(rows, CodePointTokenizer, "ids", "decoded")
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), total.alias("total"), (F.col("ids") == tokens.code_points(F.col("text"))).alias("alike"), "decoded")


def _chat_sql() -> str:
    from .catalogue import RENDER_SQL

    mark = f"'{chat.OPEN}assistant' || chr(10)"
    return f"""WITH {RENDER_SQL}, t AS (SELECT conv_id, substr(text, 1, 1024) AS text FROM rendered), p AS (SELECT *, strpos(text, {mark}) AS pos FROM t)
SELECT conv_id, len(text) AS n, pos > 0 AS mask_found, CASE WHEN pos > 0 THEN pos - 1 + {len(chat.RESPONSE_MARK)} ELSE 0 END::BIGINT AS n_masked,
 list_sum(list_transform(string_split(CASE WHEN pos > 0 THEN substr(text, pos + {len(chat.RESPONSE_MARK)}) ELSE text END, ''), lambda c: unicode(c)))::BIGINT AS label_total FROM p"""


def attach() -> None:
    """Queries whose SQL builds on the catalogue's."""

    @query(_chat_sql())
    def label_mask_chat(spark, sf_dir):
        """Response-only labels of whole conversations: rendered, tokenized, cut to 1024 tokens, and masked up to the first answer."""
        text = chat.gather_messages(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("messages")).alias("text"))
        rows = text.select("conv_id", chat.truncate(tokens.code_points(F.col("text"))).alias("ids"))
        template = F.array(*[F.lit(ord(c)) for c in chat.RESPONSE_MARK])
        out = rows.select("conv_id", F.size("ids").cast("long").alias("n"), (chat.template_end(F.col("ids"), template) > 0).alias("mask_found"), chat.mask_labels(F.col("ids"), template).alias("labels"))
        free = F.filter("labels", lambda x: x != chat.IGNORED)
        return out.select("conv_id", "n", "mask_found", F.size(F.filter("labels", lambda x: x == chat.IGNORED)).cast("long").alias("n_masked"), F.aggregate(free, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_total"))


@query("SELECT conv_id, turn, text AS answer FROM conversations")
def strip_prompt_tokens(spark, sf_dir):
    """A model's output begins with its padded prompt and ends with a stop token; what is left is the answer."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.code_points(F.col("text")).alias("said"), tokens.code_points(F.concat(F.lit("Q: "), "role")).alias("asked"))
    given = chat.pad(F.col("asked"), F.lit(16), 0, "left")
    output = F.concat(given, F.col("said"), F.array(F.lit(3), F.lit(0), F.lit(0)))
    answer = tokens.before_token(tokens.strip_prompt(output, F.size(given)), 3)
    return rows.select("conv_id", "turn", tokens.from_code_points(answer).alias("answer"))


# ---- tool calls -----------------------------------------------------------------------------------------------

_TOOL = '{"type": "function", "function": {"name": "f"}}'
_CALLS = [
    (0, [("user", "hi", []), ("assistant", "", [("f", '{"x": 1}'), ("g", "{}")]), ("tool", "1", []), ("tool", "2", []), ("assistant", "done", [])], [_TOOL]),
    (1, [("system", "Be brief.", []), ("user", "hi", []), ("critic", "no", []), ("assistant", "see", [("f", "{}")]), ("tool", "3", [])], []),
    (2, [("tool", "a", []), ("critic", "x", []), ("tool", "b", []), ("system", "late", [])], []),
]
_S, _E = chat.OPEN, chat.CLOSE
_CALLED = [
    f"{_S}system\n{chat.DEFAULT_SYSTEM}{chat.TOOLS_HEAD}\n{_TOOL}{chat.TOOLS_TAIL}{_E}\n{_S}user\nhi{_E}\n{_S}assistant\n<tool_call>\n" '{"name": "f", "arguments": {"x": 1}}' "\n</tool_call>\n<tool_call>\n"
    f'{{"name": "g", "arguments": {{}}}}\n</tool_call>{_E}\n{_S}user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response>{_E}\n{_S}assistant\ndone{_E}\n',
    f"{_S}system\nBe brief.{_E}\n{_S}user\nhi{_E}\n{_S}assistant\nsee\n<tool_call>\n" '{"name": "f", "arguments": {}}' f"\n</tool_call>{_E}\n{_S}user\n<tool_response>\n3\n</tool_response>{_E}\n",
    f"{_S}system\n{chat.DEFAULT_SYSTEM}{_E}\n{_S}user\n<tool_response>\na\n</tool_response>{_E}\n{_S}user\n<tool_response>\nb\n</tool_response>{_E}\n{_S}system\nlate{_E}\n",
]


@query(_values([(i, t) for i, t in enumerate(_CALLED)], "conv text", "BIGINT VARCHAR"))
def tool_calls_render(spark, sf_dir):
    """Tool declarations, calls, shared response blocks, unknown roles and a late system message."""
    rows = spark.createDataFrame(_CALLS, "conv long, messages array<struct<role: string, content: string, tool_calls: array<struct<name: string, arguments: string>>>>, tools array<string>")
    return rows.select("conv", chat.render_with_tools(F.col("messages"), F.col("tools")).alias("text"))


@query("SELECT conv_id, coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (role = 'user'), '') AS text FROM conversations GROUP BY conv_id")
def unknown_roles(spark, sf_dir):
    """Messages of roles that the format doesn't know give nothing: all but the user's, here, beside the default system message."""
    m = chat.gather_messages(table(spark, sf_dir, "conversations"))
    renamed = F.transform("messages", lambda x: F.struct(F.when(x["role"] == "user", "user").otherwise("critic").alias("role"), x["content"].alias("content")))
    head = f"{chat.OPEN}system\n{chat.DEFAULT_SYSTEM}{chat.CLOSE}\n"
    return m.select("conv_id", F.substring(chat.render(renamed), F.lit(len(head) + 1), F.lit(1 << 30)).alias("text"))
