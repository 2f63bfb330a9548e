"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for all other URLs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: (verdict, host and path prefix) of the query's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LEXICAL = (
    "length", "host_length", "path_length", "path_depth", "host_depth", "digit_ratio", "host_digit_ratio", "entropy",
    "host_entropy", "n_params", "n_hyphens", "longest_token", "suffix_length", "suffix_urls", "suffix_hosts", "secure",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equal lengths the first counts."""
    rule = verdict = F.lit(None).cast("string")
    for word, prefix in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, start = prefix.partition("/")
        fits = (host == own) | F.endswith(host, F.lit("." + own))
        fits &= F.startswith(path, F.lit("/" + start)) if start else F.lit(True)
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """LEXICAL without the two corpus counts, which the caller puts in place of the zeros."""
    url = url or ""
    tokens = url.replace("/", " ").replace(".", " ").replace("-", " ").replace("?", " ").replace("=", " ").replace("&", " ").split()
    query = url.partition("?")[2].partition("#")[0]
    digits = lambda s: sum(c in "0123456789" for c in s) / max(1, len(s))
    return [
        len(url), len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + bool(host), digits(url), digits(host), _entropy(url),
        _entropy(host), sum(1 for p in query.split("&") if p), host.count("-"), max(map(len, tokens), default=0), len(host.rpartition(".")[2]), 0.0, 0.0, float(url[:6].lower() == "https:"),
    ]


@dataclass
class BoostedTrees:
    """Gradient-boosted regression trees on histograms, for the logistic loss."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least: int = 5
    ridge: float = 1.0
    bias: float = 0.0
    trees: list[list[tuple]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """``y`` is 0 or 1. One class only, or no rows: every score is that class's smoothed share."""
        n, d = x.shape
        share = (y.sum() + 1.0) / (n + 2.0)
        self.bias, self.trees = math.log(share / (1 - share)), []
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
        score = np.full(n, self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree: list[tuple] = []
            self._grow(binned, edges, g, h, np.arange(n), 0, tree, score)
            self.trees.append(tree)
        return self

    def _grow(self, binned, edges, g, h, rows, level, tree, score) -> int:
        at = len(tree)
        tree.append(())
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, -1)
        if level < self.depth and len(rows) >= 2 * self.least:
            for j in range(binned.shape[1]):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, j], minlength=k))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (float(gain[b]), j, b)
        _, j, b = best
        if j < 0:
            value = self.rate * gs / (hs + self.ridge)
            score[rows] += value
            tree[at] = (-1, float(value), 0, 0)
            return at
        left = binned[rows, j] <= b
        low = self._grow(binned, edges, g, h, rows[left], level + 1, tree, score)
        high = self._grow(binned, edges, g, h, rows[~left], level + 1, tree, score)
        tree[at] = (j, float(edges[j][b]), low, high)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            col, cut, low, high = (np.array(c) for c in zip(*tree))
            for _ in range(self.depth):
                j = col[node]
                go = j >= 0
                right = x[np.arange(len(x)), np.maximum(j, 0)] > cut[node]
                node = np.where(go, np.where(right, high[node], low[node]), node)
            score += cut[node]
        return 1 / (1 + np.exp(-score))


def suffix_of(host: Column) -> Column:
    """The last two labels of the host: what a site registers under most top-level domains."""
    return F.substring_index(host, ".", -2)


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (columns url, host, path, and any others) with ``features``, LEXICAL as an array.

    The suffix statistics are the numbers of URLs and of different hosts under the URL's suffix, over all
    rows. Hosts are counted first, so a suffix with most of the rows is a row for each of its hosts.
    """
    hosts = urls.groupBy("host").agg(F.count("*").alias("n")).withColumn("suffix", suffix_of(F.col("host")))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("_urls"), F.count("*").alias("_hosts"))
    rows = urls.withColumn("suffix", suffix_of(F.col("host"))).join(suffixes, "suffix").drop("suffix")
    small_batches(urls.sparkSession)
    names = rows.columns
    at = {c: names.index(c) for c in ("url", "host", "path", "_urls", "_hosts")}
    keep = [i for i, c in enumerate(names) if c not in ("_urls", "_hosts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(at[c]).to_pylist()
            out = []
            for url, host, path, n, m in zip(*map(get, ("url", "host", "path", "_urls", "_hosts"))):
                f = lexical(url, host, path)
                f[LEXICAL.index("suffix_urls")], f[LEXICAL.index("suffix_hosts")] = math.log1p(n), math.log1p(m)
                out.append([float(v) for v in f])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out, pa.list_(pa.float64()))], [*[names[i] for i in keep], "features"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(rows.schema) if i in keep)
    return rows.mapInArrow(run, schema + ", features array<double>")


def train(labelled: DataFrame, sample: int = 20_000, **options) -> BoostedTrees:
    """Fit on about ``sample`` rows of ``labelled`` (columns page_id, url, features, label 0 or 1), all of them if there are
    no more: those whose id and url hash below the share that gives so many, whatever order and partitions."""
    share = sample / max(1, labelled.count())
    draw = F.xxhash64("page_id", "url").bitwiseAND(F.lit((1 << 31) - 1).cast("long")) / F.lit(float(1 << 31))
    part = labelled.where(draw < F.lit(float(share))).select("features", "label").toPandas()
    part = part.iloc[sorted(range(len(part)), key=lambda i: (part["label"][i], tuple(part["features"][i])))]
    x = np.array(part["features"].tolist(), float).reshape(-1, len(LEXICAL))
    return BoostedTrees(**options).fit(x, part["label"].to_numpy(float))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Verdict on each row's url (columns page_id, url).

    Returns ``page_id, host, path, rule, verdict, score``. Where a rule fits, it decides; the URLs that rules
    decide are the labelled ones that the trees are trained on (block is class 1). Elsewhere ``block`` where
    ``score``, the trees' probability of block, is above ``threshold``. Null urls and those without ``://``
    have empty host and path and are judged by the trees on what is left. Without labelled URLs the score
    is 0.5: allow. Repeated rows give a row each; an empty table an empty one; extra columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = written(with_features(urls.withColumn("rule", rule).withColumn("fixed", verdict)))
    model = train(rows.where("fixed is not null").withColumn("label", (F.col("fixed") == "block").cast("int")), sample)

    @F.pandas_udf("double")
    def score(features):
        return pd.Series(model.predict(np.array(features.tolist(), float).reshape(-1, len(LEXICAL))))

    judged = rows.withColumn("score", score("features"))
    word = F.coalesce("fixed", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", word.alias("verdict"), "score")
