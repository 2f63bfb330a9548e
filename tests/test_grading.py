import pytest

from trialframe.functions import text
from trialframe.operators import grading, records, synthesis
from trialframe.operators.completion import LookupCompleter
from trialframe.plans.evaluation import evaluate_checkpoint


@pytest.mark.parametrize(
    ("code", "score", "error"),
    [
        ("x==", 0.0, "SyntaxError"), ("import sys; sys.exit(1)", 0.2, "SubprocessCrash"), ("1/0", 0.3, "ZeroDivisionError"), ("x=1", 0.4, "NoExperimentsProduced"), ("", 0.4, "NoExperimentsProduced"),
        ('experiments=[{"a":[1,2],"b":[3,4]}]', 1.0, None), ('print(\'{"status": "success", "score": 1.0}\')\nimport os; os._exit(0)', 0.2, "SubprocessCrash"), ("x = '''a\nb'''\nassert x == 'a\\nb'\nfrom math import pi\nexperiments = [{'a': [x]}]", 1.0, None),
    ],
)
def test_ladder(code, score, error):
    row = dict(zip([x.split()[0] for x in grading.GRADE.split(", ")], grading.grade_code(code)))
    assert (row["score"], row["error_type"], row["passed"]) == (score, error, score == 1.0)
    if score == 1.0 and "b" in code and "3" in code:
        assert (row["num_factors"], row["num_trials"]) == (2, 2)


def test_timeout_import_and_synthesis():
    assert grading.grade_code("while True: pass", timeout=1.0)[1:2] + grading.grade_code("while True: pass", timeout=1.0)[9:10] == (0.1, "TimeoutExpired")
    assert grading.grade_code("x=1", dialect=grading.Dialect(module="no_such_module"))[9] == "ImportError"
    made = "class Block: pass\nb = Block()"
    assert grading.grade_code(made, dialect=grading.Dialect(module="json", block="Block", synthesize="loads"))[9] == "SynthesisError_TypeError"


def test_check_ast():
    assert grading.check_ast("import a.b as c", "a.b") == (True, True, None)
    assert grading.check_ast("def f():\n  from x import y", "x")[1] and not grading.check_ast("y = 1", "x")[1]
    assert grading.check_ast("x==")[0] is False and grading.check_ast("a\0b")[0] is False


def test_extract_code(spark):
    cases = {
        "```python\nprint(1)\n```": "print(1)", "a ```py\nx\n``` b ```PYTHON\n y=2 \n```": "y=2", "no fence  ": "no fence", "``````": "", "```python\nx=1": "```python\nx=1",
        " ```python\r\nz\r\n```": "z",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", text.extract_code(df["t"]).alias("c")).collect()} == cases


def test_synthesized_programs_pass_and_are_fixed(spark):
    rows = grading.grade(synthesis.samples(spark, 48), timeout=20.0, tasks=4).select("attempt", "task_family", "prompt", "code", "grade.*").collect()
    assert len(rows) == 48 and all(r["passed"] for r in rows), [(r["error_type"], r["error_message"], r["code"]) for r in rows if not r["passed"]][:2]
    again = {r["attempt"]: r["prompt"] for r in synthesis.samples(spark, 48).repartition(7).collect()}
    assert all(again[r["attempt"]] == r["prompt"] for r in rows)


def test_dataset_and_evaluation(spark, tmp_path):
    import pyspark.sql.functions as F

    verify = lambda d: d.withColumns({"ok": F.col("attempt") % 4 != 1, "num_trials": F.lit(4), "num_factors": F.lit(2), "exec_time_sec": F.lit(0.1)})
    data = synthesis.verified_dataset(spark, 12, 42, "val", verify)
    assert sorted(r["id"] for r in data.collect()) == [f"val_{i:05d}" for i in range(12)]
    recs = records.sft_records(data).join(data.select("id", "seq"), "id").persist()
    code = {r["prompt"]: r["canonical_code"] for r in recs.collect()}
    answers = {}
    from trialframe.plans.evaluation import generation_prompt

    for i, r in enumerate(sorted(generation_prompt(recs).collect())):
        answers[r["rendered"]] = "```python\n" + code[r["prompt"]] + "\n```" if i % 2 else "x=="
    trials, summary = evaluate_checkpoint(recs, lambda: LookupCompleter(answers), str(tmp_path / "log.jsonl"), timeout=20.0, tasks=2)
    s = summary.first()
    assert (s["num_eval_samples"], s["pass_rate_pass_at_1"], s["error_distribution"]) == (12, 0.5, {"SyntaxError": 6})
    assert trials.count() == 12 and (tmp_path / "log.summary.json").exists()
    with pytest.raises(Exception, match="fewer"):
        synthesis.first_accepted(verify(synthesis.samples(spark, 4)), 12, "x").collect()
