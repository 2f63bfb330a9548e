import random

import pytest
from pyspark.sql import functions as F

from trialframe import cli
from trialframe.operators import ordering, resampling
from trialframe.operators.completion import PAIRS, Sampling, load_completer
from trialframe.sources import files


def test_numbers_are_dense_and_ordered(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *range(50)]) for _ in range(700)]
    rows = [(v, i, rng.choice(["a", "b", None])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v long, i long, p string").repartition(5)
    got = {r["i"]: r["number"] for r in ordering.numbered(df, "v", "i", ranges=9).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r[1]: n for n, r in enumerate(order)}
    per = {r["i"]: r["number"] for r in ordering.numbered(df, "v", "i", partition="p", ranges=9).collect()}
    assert per == {r[1]: n for p in ("a", "b", None) for n, r in enumerate(x for x in order if x[2] == p)}
    assert ordering.numbered(df.limit(0), "v").count() == 0


def test_order_by_last_place(spark):
    items = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "id string, seq long")
    rows = spark.createDataFrame([("b", 9), ("x", 8), ("a", 7)], "id string, v long")
    assert [(r["id"], r["seq"]) for r in ordering.reordered(rows, items).collect()] == [("x", 0), ("b", 1), ("a", 2)]


def test_subsamples_are_distinct_and_even(spark):
    pairs = spark.range(12).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("diff"))
    means = [r["diff"] for r in resampling.subsample_means(pairs, 12, 20).collect()]
    assert means == [pytest.approx(5.5)] * 20  # all of them, each once
    assert len(resampling.subsample_means(pairs, 5, 400).collect()) == 400
    with pytest.raises(Exception, match="fewer than 13"):
        resampling.subsample_means(pairs, 13, 1).collect()


def test_log_factorial(spark):
    import math

    rows = spark.range(300).select("id", resampling.log_factorial(F.col("id")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(math.lgamma(r["id"] + 1), abs=1e-9) for r in rows)


def test_sampling_switch():
    assert Sampling().greedy and Sampling(1e-4).greedy and not PAIRS.greedy
    assert Sampling().settings() == {"max_new_tokens": 512, "do_sample": False}
    assert PAIRS.settings() == {"max_new_tokens": 400, "do_sample": True, "temperature": 0.8, "top_p": 0.95}
    assert load_completer("collections:Counter")() == {}
    with pytest.raises(ValueError):
        load_completer("nothing")



def test_command_line(spark, tmp_path):
    cli.main(["build", "--output-dir", str(tmp_path), "--num-train", "4", "--num-val", "2", "--num-test", "0"], spark)
    records = cli.read_records(spark, f"{tmp_path}/train.jsonl")
    assert [r["id"] for r in records.orderBy("seq").collect()] == [f"train_{i:05d}" for i in range(4)]
    assert (tmp_path / "train.jsonl").is_file() and not (tmp_path / "test_heldout.jsonl").exists()
    model = "trialframe.operators.completion:FixedCompleter"
    cli.main(["evaluate", "--model", model, "--adapter", "experiments = [{'a': [1]}]", "--input-file", f"{tmp_path}/train.jsonl", "--output-file", f"{tmp_path}/log.jsonl", "--max-samples", "3"], spark)
    log = cli.read_trials(spark, f"{tmp_path}/log.jsonl")
    assert [r["passed"] for r in log.orderBy("seq").collect()] == [True] * 3
    assert (tmp_path / "log.summary.json").is_file()
    cli.main(["pairs", "--model", model, "--adapter", "1/0", "--input-file", f"{tmp_path}/train.jsonl", "--output-file", f"{tmp_path}/pairs.jsonl", "--max-prompts", "2"], spark)
    assert files.infer_jsonl(spark, f"{tmp_path}/pairs.jsonl").first()["rejected_error"] == "ZeroDivisionError: division by zero"
    with pytest.raises(SystemExit):
        cli.main(["build"], spark)
