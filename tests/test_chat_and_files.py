import json

import pytest
import pyspark.sql.functions as F

from trialframe.functions import chat, tokens
from trialframe.sources import files

S, E = chat.OPEN, chat.CLOSE


def said(spark, turns, **options):
    df = spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], "m array<struct<role: string, content: string>>")
    return df.select(chat.render(F.col("m"), **options)).first()[0]


def test_render(spark):
    head = f"{S}system\n{chat.DEFAULT_SYSTEM}{E}\n"
    assert said(spark, [("user", "hi")]) == head + f"{S}user\nhi{E}\n"
    assert said(spark, [("system", "be"), ("user", "hi"), ("assistant", "yo")]) == f"{S}system\nbe{E}\n{S}user\nhi{E}\n{S}assistant\nyo{E}\n"
    assert said(spark, [("user", "hi")], generation_prompt=True).endswith(f"{S}assistant\n")
    assert said(spark, [("user", "a"), ("system", "late"), ("strange", "x")]) == head + f"{S}user\na{E}\n{S}system\nlate{E}\n"
    two = said(spark, [("user", "q"), ("tool", "1"), ("tool", "2"), ("assistant", "ok")])
    assert two == head + f"{S}user\nq{E}\n{S}user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response>{E}\n{S}assistant\nok{E}\n"


def test_tools(spark):
    kind = "m array<struct<role: string, content: string, tool_calls: array<struct<name: string, arguments: string>>>>, t array<string>"
    df = spark.createDataFrame([([("user", "q", None), ("assistant", "", [("f", '{"x": 1}')])], ['{"name": "f"}'])], kind)
    out = df.select(chat.render_with_tools(F.col("m"), F.col("t"))).first()[0]
    assert "<tools>\n{\"name\": \"f\"}\n</tools>" in out and out.endswith(f'{S}assistant\n<tool_call>\n{{"name": "f", "arguments": {{"x": 1}}}}\n</tool_call>{E}\n')


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([5, 1, 2, 7, 1, 2, 8],), ([5, 7],), ([1],)], "ids array<int>")
    got = [r[0] for r in df.select(chat.mask_labels(F.col("ids"), F.array(F.lit(1), F.lit(2)), F.size("ids") - 1)).collect()]
    assert got == [[-100, -100, -100, 7, 1, 2, -100], [5, -100], [-100]]
    assert df.select(chat.pad(chat.truncate(F.col("ids"), 2), F.lit(3), 0, "left")).first()[0] == [0, 5, 1]


def test_jsonl_log_and_config(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    files.write_text(path, '{"id": "é", "n": null}\n\n   \n{"id": "b", "n": 2}\n')
    df = files.read_jsonl(spark, path, "id string, n int")
    assert [tuple(r) for r in df.collect()] == [("é", None), ("b", 2)]
    files.write_jsonl(df, str(tmp_path / "out"), "id")
    text = (tmp_path / "out").read_text()
    assert text.splitlines() == ['{"id":"b","n":2}', '{"id":"é","n":null}']
    files.write_text(path, "{bad\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, "id string, n int").collect()
    log = str(tmp_path / "log.json")
    files.write_text(log, json.dumps([{"loss": 1.0, "step": 5}, {"eval_loss": 0.5, "step": 5, "eval_rewards/margins": 2.0}, {"train_runtime": 9.0, "step": 5}], indent=1))
    got = files.read_train_log(spark, log)
    assert sorted(r["record_kind"] for r in got.collect()) == ["eval", "final", "train"]
    yaml = "model:\n  name: x  # the base\n  rate: 2.0e-4\nlora:\n  modules:\n    - q\n    - k\n  bias: none\nseed: 42\nflags: [a, b]\non: true\n"
    assert files.parse_simple_yaml(yaml) == {"model": {"name": "x", "rate": 2e-4}, "lora": {"modules": ["q", "k"], "bias": None}, "seed": 42, "flags": ["a", "b"], "on": True}


def test_stream_equals_batch(spark, tmp_path):
    from trialframe.operators.trials import family_breakdown
    from trialframe.schemas import TRIALS
    from trialframe.streaming.summaries import read_trials, running_breakdown

    rows = [{"id": str(i), "task_family": f"f{i % 3}", "passed": i % 2 == 0, "score": i / 10} for i in range(30)]
    for k in range(3):
        files.write_text(str(tmp_path / "in" / f"{k}.json"), "\n".join(map(json.dumps, rows[k::3])) + "\n")
    q = running_breakdown(read_trials(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.schema(TRIALS).json(str(tmp_path / "in")).withColumn("seq", F.col("id").cast("long"))
    want = {r["task_family"]: (r["n"], r["pass_rate"], pytest.approx(r["mean_score"])) for r in family_breakdown(batch).collect()}
    assert {r["task_family"]: (r["n"], r["pass_rate"], r["mean_score"]) for r in spark.sql("SELECT * FROM running").collect()} == want


def test_workers_hold_tokens_of_few_rows(spark):
    """Tokens of a whole batch of 10,000 rows were Python's numbers at once."""

    class Meter:
        """Tokens that don't share Python's small numbers, and last the worker's MB."""

        def encode(self, text):
            with open("/proc/self/statm") as f:
                return [*range(1000, 2500), int(f.read().split()[1]) // 256]

        def decode(self, ids):
            return str(len(ids))

    rows = spark.range(10_000).coalesce(1).selectExpr("id", "if(id % 10 = 3, null, 'x') as text")
    ids = tokens.tokenize(rows, Meter)
    mb = ids.selectExpr("element_at(ids, -1) as mb").selectExpr("max(mb) - min(mb)", "count(mb)").first()
    assert mb[1] == 9000 and mb[0] < 100, mb
    assert tokens.detokenize(ids, Meter, "ids", "said").groupBy("said").count().collect() and ids.where("ids is null").count() == 1000
