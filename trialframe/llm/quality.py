"""Quality rules: word and repetition statistics, and robust multivariate outliers per language and source."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, if_few, map_texts, spread_join, written

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Statistics that the outlier test uses; shares are taken as square roots, which evens out their spread.
FEATURES = ("log_word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")
#: Least spread of each: a group whose documents all agree must not reject the first that differs a little.
FLOORS = (0.15, 0.10, 0.15, 0.12, 0.12, 0.10)
BASE = "doc_id {id}, lang {lang}, source {source}, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def repeated_words(words: list[str], width: int = 8) -> int:
    """Words that lie in a ``width``-word window which occurs twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for j in range(width):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.sort(roll)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(roll, twice)).tolist()
    seen = Counter(tuple(words[i : i + width]) for i in at)  # the words decide, not their hashes
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + width])] > 1:
            cover[i] += 1
            cover[i + width] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str | None, width: int = 8) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the values of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, *[0.0] * len(FEATURES))
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, dup, full = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(SPACE):
            full += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words, width)
    upper = len(UPPER.findall(text))
    # One line or word more in each share: one repeated line of two is no sign by itself.
    return (
        n, chars, symbols, dup, repeat,
        float(np.log(chars / n)), float(np.sqrt(symbols / (n + 10))), float(np.sqrt(dup / (full + 5))),
        float(np.sqrt(repeat / (n + 50))), float(np.sqrt(max(0.0, upper / chars - 0.05))), float(np.sqrt(text.count("!") / (n + 10))),
    )


def document_statistics(docs: DataFrame, width: int = 8) -> DataFrame:
    """One row for each of ``docs``: id, lang, source, the text's hash as ``key``, the base counts and FEATURES. Null text: no words."""
    kinds = {k: docs.schema[c].dataType.simpleString() for k, c in (("id", "doc_id"), ("lang", "lang"), ("source", "source"))}
    schema = BASE.format(**kinds) + "".join(f", {f} double" for f in FEATURES)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*(statistics(t, width) for t in b.column(3).to_pylist()))) or [()] * (5 + len(FEATURES))
        arrays = [pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(cols)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), *arrays], [x.split()[0] for x in schema.split(", ")])

    return map_texts(docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("key")), run, schema)


def _distance() -> Column:
    """Squared Mahalanobis distance from ``center`` under the flat inverse covariance ``inverse``."""
    d = len(FEATURES)
    off = [F.col(f) - F.col("center")[i] for i, f in enumerate(FEATURES)]
    return sum((off[i] * off[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))


def _fit(groups: DataFrame, prior: float, core: float) -> DataFrame:
    """Center, inverse covariance and the logarithm of its determinant of each group from the sums over its core rows."""
    d = len(FEATURES)
    floor = np.diag(np.square(FLOORS))
    # The core lacks the tails: under normal data its spread is this much too small.
    grow = 1.0 / core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n, s, q = (b.column(i).to_pylist() for i in range(4))
            out = []
            for m, x, y in zip(n, s, q):
                mean = np.array(x) / m
                cov = np.array(y).reshape(d, d) / m - np.outer(mean, mean)
                cov = grow * (m * cov + prior * floor) / (m + prior) + floor
                out.append((mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([o[i] for o in out], pa.list_(pa.float64())) for i in (0, 1)), pa.array([o[2] for o in out], pa.float64()), b.column(4)],
                ["g", "center", "inverse", "logdet", "rows"],
            )

    return groups.mapInArrow(run, "g string, center array<double>, inverse array<double>, logdet double, rows long")


def _with_fit(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group's ``fit``: by broadcast while there are few groups, else with hot groups spread."""
    return rows.join(F.broadcast(fit), "g") if fit.count() <= 10_000 else spread_join(rows, fit, "g", "rows")


def robust_distances(stats: DataFrame, by: list[str], core: float = 0.75, steps: int = 12, prior: float = 20.0, steady: float = 0.01) -> DataFrame:
    """``stats`` with ``distance``: squared Mahalanobis distance under its group's minimum-covariance-determinant fit.

    Each group starts at its coordinate medians; a concentration step keeps the ``core`` share of its rows
    that lie nearest and refits center and covariance on them, which lowers the determinant. Steps go on until no group's
    determinant moves by more than ``steady`` of itself, or there were ``steps``. All rows
    of ``stats`` count, by sums that are combined before the shuffle, and a fit reaches its rows by broadcast or over
    spread keys, so no group's rows meet in one task.
    Small groups lean on FLOORS with the weight of ``prior`` rows. Nulls in ``by`` form a group.
    """
    d = len(FEATURES)
    rows = written(stats.withColumn("g", F.to_json(F.struct(*by))))
    mid = F.percentile_approx
    floor = np.linalg.inv(np.diag(np.square(FLOORS))).ravel().tolist()
    fit = rows.groupBy("g").agg(F.count("*").alias("rows"), F.array(*[mid(f, 0.5, 1000).cast("double") for f in FEATURES]).alias("center"))
    fit = written(fit.withColumns({"inverse": F.array(*map(F.lit, floor)), "logdet": F.lit(None).cast("double")}))
    for _ in range(steps):
        far = _with_fit(rows, fit).withColumn("distance", _distance())
        edge = written(far.groupBy("g").agg(mid("distance", core, 1000).alias("edge")))
        near = _with_fit(rows, fit.join(edge, "g")).where(_distance() <= F.col("edge"))
        sums = near.groupBy("g").agg(
            F.count("*").alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("s"),
            F.array(*[F.sum(F.col(FEATURES[min(i, j)]) * F.col(FEATURES[max(i, j)])) for i in range(d) for j in range(d)]).alias("q"), F.min("rows").alias("rows"),
        )
        new = written(_fit(sums, prior, core))
        before = fit.select("g", F.col("logdet").alias("was"))
        moved = new.join(before, "g").agg(F.max(F.coalesce(F.abs(F.col("logdet") - F.col("was")), F.lit(1.0)))).first()[0]
        forget(edge)
        forget(fit)
        fit = new
        if (moved or 0.0) <= steady:
            break
    return _with_fit(rows, fit).withColumn("distance", _distance()).drop("g", "center", "inverse", "logdet", "rows")


def quality_rules(docs: DataFrame, limit: float = 25.0, min_words: int = 20, repeat_percent: int = 30, width: int = 8, named: bool = False) -> DataFrame:
    """Base counts, verdicts and distance of each row of ``docs`` (columns doc_id, text, lang, source).

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance, key`` (the text's hash). ``kept`` is false where ``base_failed``, else whether the distance is at most ``limit``
    (a chi-square with len(FEATURES) degrees passes 25 three times in ten thousand). ``named`` adds ``g``, a hash of language and source.
    Null and empty texts have no words and fail. Null lang or source is a group of its own. Repeated rows
    count as often as they come; an empty table gives an empty one; extra columns are ignored.
    """
    stats = document_statistics(docs, width)
    group = [F.xxhash64(F.col("lang").isNull(), "lang", F.col("source").isNull(), "source").alias("g")] if named else []
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return (
        robust_distances(stats, ["lang", "source"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("distance") <= limit))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "key", *group)
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, whatever their names.

    Rows are told apart by id, text, language and source: the verdict on one has no say on others that only share its id, or have none.
    An empty table gives an empty one."""
    bad = quality_rules(docs.select("doc_id", "text", "lang", "source"), named=True, **options).where(~F.col("kept"))
    bad = written(bad.select("doc_id", "key", "g").distinct())
    own = F.xxhash64(docs["text"]), F.xxhash64(docs["lang"].isNull(), docs["lang"], docs["source"].isNull(), docs["source"])
    return docs.join(if_few(bad), docs["doc_id"].eqNullSafe(bad["doc_id"]) & (own[0] == bad["key"]) & (own[1] == bad["g"]), "left_anti")
