import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from trialframe.operators import resampling, trials
from trialframe.plans.report import analyze, markdown, report_rows

# Published family sizes and one consistent set of scores behind the published means of the base log.
FAMILIES = {"factorial_crossing": 23, "partial_crossing": 27, "stroop_congruency": 15, "constrained_design": 21, "task_switching_transition": 28, "flanker_task": 12, "nback_window": 24}
BASE = {"factorial_crossing": [0.0] * 2 + [0.4] * 4, "constrained_design": [0.0] * 7, "flanker_task": [0.0]}
MEANS = {"factorial_crossing": 0.29130434782608694, "partial_crossing": 0.3, "stroop_congruency": 0.3, "constrained_design": 0.2, "task_switching_transition": 0.3, "flanker_task": 0.275, "nback_window": 0.3}


def log(spark, passed):
    rows = []
    for family, n in FAMILIES.items():
        scores = [1.0] * n if passed else BASE.get(family, []) + [0.3] * (n - len(BASE.get(family, [])))
        for s in scores:
            error = None if s == 1.0 else {0.0: "SyntaxError", 0.4: "NoExperimentsProduced"}.get(s, "ValueError")
            rows.append((f"t{len(rows):03d}", len(rows), family, s == 1.0, s, error))
    return spark.createDataFrame(rows, "id string, seq long, task_family string, passed boolean, score double, error_type string")


def test_golden_summaries(spark):
    base = log(spark, False)
    got = {r["task_family"]: (r["n"], r["mean_score"], r["pass_rate"]) for r in trials.family_breakdown(base).collect()}
    assert {k: (n, pytest.approx(MEANS[k]), 0.0) for k, n in FAMILIES.items()} == got
    assert trials.overall_summary(base).first()["mean_score"] == pytest.approx(42.4 / 150)
    assert [r["task_family"] for r in trials.family_breakdown(base).collect()] == list(FAMILIES)
    assert {r["error_type"]: r["n"] for r in trials.error_distribution(base).collect()} == {"SyntaxError": 10, "NoExperimentsProduced": 4, "ValueError": 136}
    assert trials.overall_summary(base.limit(0)).first()["pass_rate"] == 0.0
    assert trials.summary_maps(base).first()["family_breakdown"]["flanker_task"]["n"] == 12


def test_golden_report(spark):
    a, b = log(spark, False), log(spark, True)
    r = analyze(a, b, n_boot=200, n_perm=100, n_sims=50, compat=True).first()
    assert (r["observed"], r["ci_low"], r["ci_high"], r["p_value"], r["degenerate"], r["n_clusters"]) == (1.0, 1.0, 1.0, 0.0, True, 7)
    assert r["mde"] == pytest.approx(0.02287, abs=1e-5) and (r["mean_diff"], r["low"], r["high"], r["pick_b_rate"]) == (1.0, 1.0, 1.0, 1.0)
    same = analyze(a, a, n_boot=50, n_perm=20, n_sims=5).first()
    assert (same["observed"], same["p_value"], same["mde"]) == (0.0, 1.0, 0.0)
    assert "+100.0 %" in markdown(report_rows({"base": a, "tuned": b}, "base", n_boot=50, n_perm=20, n_sims=5))


def test_bootstrap_equals_joined_rows_in_both_modes(spark):
    rng = np.random.default_rng(0)
    rows = [(f"i{i}", i, f"c{i % 5}", bool(rng.random() < 0.4), bool(rng.random() < 0.6)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, seq long, task_family string, a boolean, b boolean")
    a, b = df.withColumn("passed", F.col("a")), df.withColumn("passed", F.col("b"))
    stats = trials.cluster_stats(a, b).persist()
    index = resampling.classic_indices(5, 40)
    draws = {r["draw_id"]: r["diff"] for r in resampling.bootstrap_draws_from(stats, index).collect()}
    by = {c: ([r[3] for r in rows if r[2] == c], [r[4] for r in rows if r[2] == c]) for c in sorted({r[2] for r in rows})}
    names = sorted(by)
    for d, row in enumerate(index):
        want = np.mean(sum((by[names[i]][1] for i in row), [])) - np.mean(sum((by[names[i]][0] for i in row), []))
        assert draws[d] == pytest.approx(want)
    one = resampling.bootstrap_draws(stats, 30).orderBy("draw_id").collect()
    assert one == resampling.bootstrap_draws(stats.repartition(3), 30).orderBy("draw_id").collect()


def test_edges(spark):
    a = spark.createDataFrame([("x", 0, "c", True), ("y", 1, "d", False)], "id string, seq long, task_family string, passed boolean")
    b = a.withColumn("task_family", F.lit("c")).union(spark.createDataFrame([("z", 2, "only_b", True)], a.schema))
    stats = {r["task_family"]: (r["n_a"], r["n_b"]) for r in trials.cluster_stats(a, b).collect()}
    assert stats == {"c": (1, 2), "d": (1, 0)}
    check = trials.check_pairing(a, b).first()
    assert (check["only_b"], check["ok"]) == (1, False)
    with pytest.raises(Exception, match="fewer than 50"):
        resampling.subsample_simulation(trials.paired(a, b), 50, 5).collect()
    with pytest.raises(Exception, match="passed is null"):
        trials.paired(a.withColumn("passed", F.lit(None).cast("boolean")), b).collect()
    exact = resampling.permutation_exact(spark.createDataFrame([("a", 1.0)] * 6 + [("b", -1.0), ("c", 0.0)], "id string, diff double")).first()
    assert exact["p_value"] == pytest.approx(sum(math.comb(7, k) for k in (0, 1, 6, 7)) / 128)
