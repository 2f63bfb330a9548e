"""Resampling statistics as queries: bootstrap by cluster, sign-flip permutation, detectable effect, subsampling.

Draws come from md5 of seed, draw and slot, so results do not depend on partitions or retries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import digest, draw
from ..functions.text import normal_quantile
from .ordering import numbered
from .trials import checked_metric, cluster_stats

#: Permutations that share one md5: its first 32 bits are their signs.
SIGNS = 32


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, by Stirling's series from 10 on: right to 1e-12."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - sum((F.log(n.cast("double") + float(i)) for i in range(1, 11)), F.lit(0.0))


def bootstrap_draws(stats: DataFrame, n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """``draw_id, diff``: mean of b minus mean of a over as many clusters as there are, drawn with replacement.

    Works on the clusters' sums (``cluster_stats``), so a draw costs a row for each cluster, not for each trial. A draw
    without rows on one side has a null diff.
    """
    k = stats.agg(F.count("*").alias("k"))
    slots = k.where("k > 0").select("k", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("draw_id"))
    slots = slots.select("draw_id", "k", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("slot"))
    slots = slots.select("draw_id", draw(F.col("k"), seed, F.col("draw_id"), F.col("slot")).cast("int").alias("idx"))
    agg = slots.join(stats, "idx").groupBy("draw_id").agg(*[F.sum(c).alias(c) for c in ("n_a", "s_a", "n_b", "s_b")])
    return agg.select("draw_id", (F.try_divide("s_b", "n_b") - F.try_divide("s_a", "n_a")).alias("diff"))


def bootstrap_draws_from(stats: DataFrame, index: np.ndarray) -> DataFrame:
    """As ``bootstrap_draws`` for a given matrix of cluster numbers, a row for each draw (see ``classic_indices``)."""
    spark = stats.sparkSession
    long = spark.createDataFrame([(b, i) for b, row in enumerate(index.tolist()) for i in row], "draw_id int, idx int")
    agg = long.join(stats, "idx").groupBy("draw_id").agg(*[F.sum(c).alias(c) for c in ("n_a", "s_a", "n_b", "s_b")])
    return agg.select("draw_id", (F.try_divide("s_b", "n_b") - F.try_divide("s_a", "n_a")).alias("diff"))


def classic_indices(k: int, n_boot: int = 5000, seed: int = 42) -> np.ndarray:
    """Cluster numbers from numpy's Mersenne twister, drawn one row after another."""
    return np.random.RandomState(seed).randint(0, k, (n_boot, k))


def classic_signs(n: int, n_perm: int = 10_000, seed: int = 42) -> np.ndarray:
    return np.random.RandomState(seed).choice([-1, 1], size=(n_perm, n))


def observed_diff(a: DataFrame, b: DataFrame, metric: str = "passed") -> DataFrame:
    left = checked_metric(a, metric).agg(F.avg(metric).alias("mean_a"))
    right = checked_metric(b, metric).agg(F.avg(metric).alias("mean_b"))
    return left.join(right).select((F.col("mean_b") - F.col("mean_a")).alias("observed"))


def cluster_bootstrap(a: DataFrame, b: DataFrame, cluster: str = "task_family", metric: str = "passed", n_boot: int = 5000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: ``observed, low, high, n_clusters, degenerate`` (all draws alike)."""
    stats = cluster_stats(a, b, cluster, metric)
    alpha = (1 - level) / 2
    ci = bootstrap_draws(stats, n_boot, seed).agg(
        F.percentile("diff", F.lit(alpha)).alias("low"), F.percentile("diff", F.lit(1 - alpha)).alias("high"), (F.min("diff") == F.max("diff")).alias("degenerate")
    )
    return observed_diff(a, b, metric).join(ci).join(stats.agg(F.count("*").alias("n_clusters"))).select("observed", "low", "high", "n_clusters", "degenerate")


def permutation_test(pairs: DataFrame, n_perm: int = 10_000, seed: int = 42, compat: bool = False) -> DataFrame:
    """One row: ``n, observed, exceed, p_value`` of the two-sided sign-flip test on ``diff`` of ``pairs`` (columns id, diff).

    Pairs without a difference can't change a sum and are left out before signs are drawn. One md5 of a pair and a
    block of ``SIGNS`` permutations gives the pair's signs in all of them, as bits. Only how many pairs of each
    difference have each bit set is added up, so rows are pairs times blocks before the shuffle and different
    differences times blocks after it. ``exceed`` counts permutations at least as far from 0 as the data.
    ``p_value`` is (exceed + 1) / (n_perm + 1), or with ``compat`` exceed / n_perm. Sums are of decimals, so equal sums compare equal.
    """
    exact = F.round("diff", 6).cast("decimal(18,6)")
    total = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(exact), F.lit(0)).alias("s"))
    moved = pairs.where("diff <> 0").select("id", exact.alias("d"), F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // SIGNS))).alias("block"))
    moved = moved.select("block", "d", digest(seed, F.col("block"), F.col("id")).alias("bits"))
    ones = F.array(*[F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1))) for k in range(SIGNS)])
    per = moved.groupBy("block", "d").agg(F.count("*").alias("k"), ones.alias("ones"))
    per = per.select((F.col("block") * SIGNS).alias("first"), "d", "k", F.posexplode("ones").alias("bit", "minus")).where(F.col("first") + F.col("bit") < n_perm)
    sums = per.groupBy((F.col("first") + F.col("bit")).alias("perm")).agg(F.sum(F.col("d") * (F.col("k") - 2 * F.col("minus"))).alias("m"))
    agg = sums.join(total).agg(F.count_if(F.abs("m") >= F.abs("s")).alias("far"), F.count("*").alias("made"))
    # Without any difference no permutation was made, and each equals the data.
    out = total.join(agg).withColumn("exceed", F.col("far") + F.lit(n_perm) - F.when(F.col("made") > 0, F.lit(n_perm)).otherwise(F.lit(0)))
    p = F.col("exceed") / F.lit(float(n_perm)) if compat else (F.col("exceed") + 1) / F.lit(float(n_perm + 1))
    return out.select("n", F.coalesce(F.try_divide(F.col("s").cast("double"), F.col("n").cast("double")), F.lit(0.0)).alias("observed"), "exceed", p.alias("p_value"))


def permutation_exact(pairs: DataFrame) -> DataFrame:
    """One row: ``up, down, p_value``, exact for differences of -1, 0 and 1: the two-sided sign test.

    The probability adds up binomial terms, each by its own logarithm; there is a row for each term, at most one for each pair.
    """
    c = pairs.agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))
    c = c.withColumn("m", F.col("up") + F.col("down")).withColumn("gap", F.abs(F.col("up") - F.col("down")))
    logs = c.select("up", "down", "m", "gap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("k"))
    ways = log_factorial(F.col("m")) - log_factorial(F.col("k")) - log_factorial(F.col("m") - F.col("k"))
    terms = logs.withColumn("ln", ways - F.col("m") * F.log(F.lit(2.0)))
    return terms.groupBy("up", "down").agg(F.least(F.lit(1.0), F.sum(F.when(F.abs(2 * F.col("k") - F.col("m")) >= F.col("gap"), F.exp("ln")).otherwise(0.0))).alias("p_value"))


def detectable_effect(pairs: DataFrame, alpha: float = 0.05, power: float = 0.80, compat: bool = False) -> DataFrame:
    """One row: ``n, sd, mde``: the least mean difference that ``n`` pairs show with ``power``. ``compat`` takes 0.1 for a spread of 0."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    agg = pairs.agg(F.count("*").alias("n"), F.stddev_pop("diff").alias("sd"))
    used = F.when(F.col("sd") == 0, F.lit(0.1)).otherwise(F.col("sd")) if compat else F.col("sd")
    return agg.withColumn("mde", F.try_divide(F.lit(z) * used, F.sqrt("n")))


def subsample_means(pairs: DataFrame, size: int = 50, n_sims: int = 1000, seed: int = 42) -> DataFrame:
    """``sim, diff, winner`` of ``n_sims`` samples of ``size`` pairs without replacement. Fewer pairs than ``size`` raise.

    Pairs are numbered once, by a hash of their id. Each simulation draws ``size`` numbers by Floyd's method (slot i
    draws up to n - size + i and takes that limit itself if the number is there already) and looks them up, so there are
    ``n_sims`` times ``size`` rows whatever the number of pairs.
    """
    enough = pairs.agg(F.count("*").alias("n")).select(F.when(F.col("n") < size, F.raise_error(F.lit(f"fewer than {size} pairs"))).otherwise(F.col("n")).alias("n"))
    sims = enough.select("n", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim"))

    def add(have, slot):
        most = F.col("n") - F.lit(size) + slot
        pick = lambda t: F.when(F.array_contains(have, t), most).otherwise(t)
        return F.concat(have, F.transform(F.array(draw(most + 1, seed, F.col("sim"), slot)), pick))

    chosen = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.array().cast("array<bigint>"), add)
    chosen = sims.select("sim", F.explode(chosen).alias("number"))
    rows = numbered(pairs.select(digest(seed, F.col("id")).alias("h"), "id", "diff"), "h", "id").select("number", "diff")
    agg = chosen.join(rows, "number").groupBy("sim").agg(F.avg("diff").alias("diff"))
    return agg.withColumn("winner", F.when(F.col("diff") > 0, "B").when(F.col("diff") < 0, "A").otherwise("Tie"))


def subsample_simulation(pairs: DataFrame, size: int = 50, n_sims: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean, sd, min, max, 2.5 and 97.5 percentiles of the samples' differences and how often B wins."""
    return subsample_means(pairs, size, n_sims, seed).agg(
        F.avg("diff").alias("mean_diff"), F.stddev_pop("diff").alias("sd_diff"), F.min("diff").alias("min_diff"), F.max("diff").alias("max_diff"),
        F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"), F.avg(F.when(F.col("winner") == "B", 1.0).otherwise(0.0)).alias("pick_b_rate"),
    )
