"""Code grading: syntax check, sandboxed run and the stepped score.

Untrusted code never runs in a worker: each row gets a child interpreter of its own, isolated (-I), with an empty
environment, a temporary folder, limits on time, memory and files, and its process group is killed at the end.
"""

from __future__ import annotations

import ast
import json
import os
import secrets
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_code
from ..schemas import GRADE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Scores by outcome.
LADDER = {"syntax": 0.0, "import": 0.1, "timeout": 0.1, "crash": 0.2, "raised": 0.3, "nothing": 0.4, "synthesis": 0.6, "passed": 1.0}


@dataclass(frozen=True)
class Dialect:
    """What a program must do. ``module`` is imported first (a failure scores 0.1); ``block`` and ``synthesize`` name what
    turns an object of a program into experiments when it left none itself."""

    module: str = ""
    variable: str = "experiments"
    block: str = ""
    synthesize: str = ""


# The child reads its job from stdin and writes one line, marked by a word that the program can't know.
_CHILD = r"""
import importlib, json, sys, time
job = json.loads(sys.stdin.readline())
out, d = sys.stdout, job["dialect"]
def say(**found):
    out.write("\n" + job["mark"] + json.dumps(found) + "\n"); out.flush()
def fits(v):
    return isinstance(v, list) and len(v) > 0 and all(isinstance(x, dict) for x in v)
try:
    lib = importlib.import_module(d["module"]) if d["module"] else None
except Exception as e:
    say(outcome="import", type="ImportError", message=str(e)); sys.exit()
space, began = {"__name__": "__main__"}, time.monotonic()
try:
    exec(compile(job["code"], "<graded>", "exec"), space)
except Exception as e:
    say(outcome="raised", type=type(e).__name__, message=str(e)); sys.exit()
block = None
for v in list(space.values()):
    if d["block"] and type(v).__name__ == d["block"]:
        block = v
made = space.get(d["variable"])
if not fits(made):
    made = None
    for k, v in list(space.items()):
        if not k.startswith("__") and fits(v):
            made = v
if made is None and block is not None and d["synthesize"]:
    try:
        made = getattr(lib, d["synthesize"])(block, 1)
    except Exception as e:
        say(outcome="synthesis", type="SynthesisError_" + type(e).__name__, message=str(e), seconds=time.monotonic() - began); sys.exit()
if not fits(made):
    say(outcome="nothing", type="NoExperimentsProduced", message="", block=block is not None, seconds=time.monotonic() - began)
else:
    first = made[0]
    say(outcome="passed", factors=len(first), trials=len(next(iter(first.values()), [])) if first and hasattr(next(iter(first.values())), "__len__") else 0, seconds=time.monotonic() - began)
"""


def check_ast(code: str, module: str = "") -> tuple[bool, bool, str | None]:
    """Whether ``code`` parses, whether it imports a module whose name holds ``module``, and the error."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return False, False, f"{type(e).__name__}: {e}"
    names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
    names += [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
    return True, any(module in n for n in names) if module else True, None


def _limits(memory_mb: int, seconds: float):
    def apply() -> None:
        import resource

        os.setsid()
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 2, int(seconds) + 2))
        resource.setrlimit(resource.RLIMIT_FSIZE, (16 << 20, 16 << 20))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))

    return apply


def grade_code(code: str | None, timeout: float = 10.0, dialect: Dialect | None = None, python: str = sys.executable, memory_mb: int = 1024) -> tuple:
    """One row of the schema GRADE. Null code counts as empty."""
    dialect, code = dialect or Dialect(), code or ""
    ok, imports, error = check_ast(code, dialect.module)
    if not ok:
        return (False, LADDER["syntax"], False, False, False, False, False, 0, 0, "SyntaxError", error, 0.0, "")
    mark = secrets.token_hex(16)
    job = json.dumps({"code": code, "mark": mark, "dialect": vars(dialect)}) + "\n"
    with tempfile.TemporaryDirectory() as folder:
        run = subprocess.Popen([python, "-I", "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=folder, env={"PATH": "/usr/bin:/bin"}, text=True, errors="replace", preexec_fn=_limits(memory_mb, timeout))
        late, began = False, time.monotonic()
        try:
            text, _ = run.communicate(job, timeout=timeout)
        except subprocess.TimeoutExpired:
            late = True
        finally:
            try:
                os.killpg(run.pid, signal.SIGKILL)
            except OSError:
                pass
        if late:
            text, _ = run.communicate()
            return (False, LADDER["timeout"], True, True, imports, False, False, 0, 0, "TimeoutExpired", f"more than {timeout:g} s", time.monotonic() - began, text[-2000:])
    found = None
    for line in text.splitlines():
        if line.startswith(mark):
            found = json.loads(line[len(mark) :])
    if found is None:
        return (False, LADDER["crash"], True, True, imports, False, False, 0, 0, "SubprocessCrash", f"exit code {run.returncode}", 0.0, text[-2000:])
    what = found["outcome"]
    passed = what == "passed"
    return (
        passed, LADDER[what], True, True, imports, passed or what == "synthesis" or bool(found.get("block")), passed, found.get("trials", 0), found.get("factors", 0),
        found.get("type"), found.get("message"), float(found.get("seconds", 0.0)), text.replace(mark, "")[-2000:],
    )


def grade(rows: DataFrame, code: str = "code", timeout: float = 10.0, dialect: Dialect | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``grade`` (struct of GRADE). A task needs up to rows times ``timeout``; ``tasks`` deals rows out before."""
    rows = rows.repartition(tasks) if tasks else rows
    names = [x.split()[0] for x in GRADE.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(f'{a}: {b}' for a, b in (x.split() for x in GRADE.split(', ')))}>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([grade_code(c, timeout, dialect) for c in part], columns=names)

    return rows.withColumn("grade", run(F.col(code)))


def ast_checks(rows: DataFrame, code: str = "code", module: str = "") -> DataFrame:
    """``rows`` with ``syntax_ok, imports_target, syntax_error``."""

    @F.pandas_udf("struct<syntax_ok: boolean, imports_target: boolean, syntax_error: string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([check_ast(c or "", module) for c in part], columns=["syntax_ok", "imports_target", "syntax_error"])

    return rows.withColumn("_c", run(F.col(code))).select("*", "_c.*").drop("_c")


def quick_grades(rows: DataFrame, completion: str = "completion", timeout: float = 10.0, dialect: Dialect | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``passed`` and ``error``: the run's error as ``Type: message``, or NoExperimentsSynthesized, or null."""
    out = grade(rows.withColumn("_code", extract_code(F.col(completion))), "_code", timeout, dialect, tasks)
    kind, message = F.col("grade.error_type"), F.col("grade.error_message")
    raised = F.when(F.startswith(message, kind), message).otherwise(F.concat_ws(": ", kind, F.when(message != "", message)))
    error = F.when(F.col("grade.passed"), F.lit(None)).when(kind == "NoExperimentsProduced", F.lit("NoExperimentsSynthesized")).otherwise(raised)
    return out.select(*[c for c in rows.columns if c not in ("passed", "error")], F.col("grade.passed").alias("passed"), error.alias("error"))


def verify_programs(rows: DataFrame, code: str = "code", timeout: float = 10.0, dialect: Dialect | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``ok, num_trials, num_factors, exec_time_sec`` from a run of their program: the data set builder's verifier."""
    out = grade(rows, code, timeout, dialect, tasks)
    made = [F.col("grade.passed").alias("ok"), F.col("grade.num_trials").alias("num_trials"), F.col("grade.num_factors").alias("num_factors"), F.col("grade.execution_time_sec").alias("exec_time_sec")]
    return out.select(*rows.columns, *made)


def ladder_score(outcome: Column) -> Column:
    """The score of an outcome's name; null for unknown ones."""
    out = F.lit(None).cast("double")
    for name, score in LADDER.items():
        out = F.when(outcome == name, F.lit(score)).otherwise(out)
    return out


def grade_completions(rows: DataFrame, completion: str = "completion", timeout: float = 4.0, dialect: Dialect | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` (a completion and id, task_family, complexity, prompt, gen_time_sec) as TRIALS: extract, check, run, score."""
    graded = grade(rows.withColumn("_code", extract_code(F.col(completion))), "_code", timeout, dialect, tasks)
    kept = ("passed", "score", "syntax_valid", "ast_parsed", "block_created", "synthesized", "num_trials", "error_type", "error_message")
    given = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("task_family", "complexity")]
    extra = [c for c in ("seq",) if c in rows.columns]
    return graded.select("id", *extra, *given, "prompt", F.col(completion).alias("generated_completion"), *[F.col(f"grade.{c}").alias(c) for c in kept], "gen_time_sec", F.col("grade.execution_time_sec").alias("exec_time_sec"))
