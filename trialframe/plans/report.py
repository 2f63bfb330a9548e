"""Statistical comparison of checkpoints and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resampling import cluster_bootstrap, detectable_effect, permutation_test, subsample_simulation
from ..operators.trials import overall_summary, paired


def analyze(a: DataFrame, b: DataFrame, n_boot: int = 5000, n_perm: int = 10_000, n_sims: int = 1000, size: int = 50, seed: int = 42, compat: bool = False, metric: str = "passed") -> DataFrame:
    """One row with every statistic of log ``b`` against log ``a``."""
    pairs = paired(a, b, metric)
    boot = cluster_bootstrap(a, b, metric=metric, n_boot=n_boot, seed=seed)
    perm = permutation_test(pairs, n_perm, seed, compat).select("exceed", "p_value")
    mde = detectable_effect(pairs, compat=compat)
    naive = subsample_simulation(pairs, size, n_sims, seed)
    return reduce(lambda x, y: x.join(y), (perm, mde, naive), boot.withColumnsRenamed({"low": "ci_low", "high": "ci_high"}))


def report_rows(logs: dict[str, DataFrame], baseline: str, **options) -> DataFrame:
    """A row for each log: n, passes, pass rate, mean score, and against the baseline the difference, interval, p-value and verdict."""
    out = []
    for name, log in logs.items():
        row = overall_summary(log).select(F.lit(name).alias("model"), "n", "n_passed", "pass_rate", "mean_score")
        if name == baseline:
            none = F.lit(None).cast("double")
            row = row.select("*", none.alias("delta"), none.alias("ci_low"), none.alias("ci_high"), none.alias("p_value"), F.lit("baseline").alias("verdict"))
        else:
            stats = analyze(logs[baseline], log, **options).select(F.col("observed").alias("delta"), "ci_low", "ci_high", "p_value")
            verdict = F.when(F.col("ci_low") > 0, "better").when(F.col("ci_high") < 0, "worse").otherwise("no difference shown")
            row = row.join(stats).withColumn("verdict", verdict)
        out.append(row)
    return reduce(DataFrame.unionByName, out)


def markdown(rows: DataFrame) -> str:
    """The report table as Markdown. ``rows`` has a row for each checkpoint, few enough to collect."""
    lines = ["| model | pass@1 | mean score | difference [95% CI] | p | verdict |", "|---|---|---|---|---|---|"]
    for r in rows.collect():
        diff = "-" if r["delta"] is None else f"{100 * r['delta']:+.1f} % [{100 * r['ci_low']:+.1f}, {100 * r['ci_high']:+.1f}]"
        p = "-" if r["p_value"] is None else f"{max(r['p_value'], 0.0001):.4f}"
        lines.append(f"| {r['model']} | {100 * r['pass_rate']:.1f} % ({r['n_passed']}/{r['n']}) | {r['mean_score']:.4f} | {diff} | {p} | {r['verdict']} |")
    return "\n".join(lines) + "\n"
