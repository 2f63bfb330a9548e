"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, small_batches, written

UNKNOWN = "und"
#: Text is hashed in pieces of this many code points (each overlaps the next by the n-gram length): bounded memory.
PIECE = 1 << 20


def gram_buckets(text: str, bits: int, longest: int = 3) -> np.ndarray:
    """How often each of ``2 ** bits`` buckets is hit by the character 1- to ``longest``-grams of the whole text."""
    out = np.zeros(1 << bits, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for begin in range(0, len(code), PIECE):
        c = code[begin : begin + PIECE + longest - 1]
        fresh = min(PIECE, len(code) - begin)
        h = np.zeros(len(c), np.uint32)
        for k in range(longest):
            if len(c) <= k:
                break
            h = h[: len(c) - k] * np.uint32(0x01000193) + c[k:] + np.uint32(k + 1)
            mixed = (h[:fresh] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            out += np.bincount(mixed, minlength=1 << bits)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each bucket occurs, and how many texts there are. All rows count; each task
    sends one row for each bucket it met, so the driver gets at most ``2 ** bits`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += gram_buckets(t or "", bits) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1]), pa.array([*df[at].tolist(), n])], ["bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out, n = np.zeros(1 << bits, np.int64), 0
    for bucket, count in zip(rows["bucket"], rows["n"]):
        if bucket < 0:
            n = int(count)
        else:
            out[bucket] = count
    return out, n


def weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values (dampened counts, unit length) of one text."""
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float(x @ x))
    return at, x / norm if norm else x


@dataclass
class FtrlSoftmax:
    """Multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties."""

    n_features: int
    n_classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05

    def __post_init__(self):
        shape = (self.n_features + 1, self.n_classes)  # the last row is the bias
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.temperature = 1.0

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / step)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, self.n_features), np.append(x, 1.0)
        w = self._weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        g2 = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g2

    def matrix(self) -> np.ndarray:
        return self._weights(np.arange(self.n_features + 1)).astype(np.float32)

    def calibrate(self, scores: np.ndarray, labels: np.ndarray) -> None:
        """Temperature of the least log loss on rows that were not learned from (golden-section search on its log)."""
        if not len(labels):
            return

        def loss(t: float) -> float:
            s = scores / math.exp(t)
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

        low, high, ratio = -4.0, 4.0, (math.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = math.exp((low + high) / 2)


@dataclass
class Identifier:
    """A trained model: ``predict`` gives language and score of a text."""

    labels: list[str]
    idf: np.ndarray
    w: np.ndarray
    temperature: float
    bits: int

    def scores(self, text: str) -> np.ndarray:
        at, x = weights(gram_buckets(text, self.bits), self.idf)
        return x.astype(np.float32) @ self.w[at] + self.w[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """``und`` and 0.0 for null and for texts without a letter; of equal scores the first language by code point."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        s = self.scores(text) / self.temperature
        p = np.exp(s - s.max())
        k = int(np.argmax(s))
        return self.labels[k], float(p[k] / p.sum())


def train(docs: DataFrame, bits: int = 14, sample_per_lang: int = 500, epochs: int = 3, **options) -> Identifier:
    """Learn from ``docs`` (columns text, lang); rows without text or lang are left out.

    Document frequencies cover all rows. The classifier is fitted on a sample of ``sample_per_lang`` expected
    rows a language, chosen by the hash of text and id: a share of each language's rows, so a language with a third
    of all rows costs no more than others. Every fifth of them calibrates the temperature instead.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(known, bits)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    per = written(known.groupBy("lang").agg(F.count("*").alias("rows")))
    if per.count() <= 10_000:  # a row for each language; the texts then need no shuffle
        per = F.broadcast(per)
    draw = F.xxhash64("text", "doc_id").bitwiseAND(F.lit((1 << 31) - 1).cast("long")) / F.lit(float(1 << 31))
    part = known.join(per, "lang").where(draw < F.lit(float(sample_per_lang)) / F.col("rows")).select("lang", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [weights(gram_buckets(t, bits), idf) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float32()))], ["lang", "at", "x"]
        )

    rows = map_texts(part, run, "lang string, at array<int>, x array<float>").toPandas()
    labels = sorted(set(rows["lang"]))
    # A fixed order whatever the partitions: by language and features, then shuffled by a fixed seed.
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["lang"][i], tuple(rows["at"][i]), tuple(rows["x"][i])))]
    order = np.random.default_rng(7).permutation(len(rows))
    data = [(np.asarray(rows["at"].iloc[i], np.int64), np.asarray(rows["x"].iloc[i], float), labels.index(rows["lang"].iloc[i])) for i in order]
    held = data[::5] if len(data) >= 50 else []
    fit = [r for i, r in enumerate(data) if i % 5] if held else data
    model = FtrlSoftmax(1 << bits, max(1, len(labels)), **options)
    for _ in range(epochs):
        for row in fit:
            model.learn(*row)
    w = model.matrix()
    if held:
        model.calibrate(np.stack([x.astype(np.float32) @ w[at] + w[-1] for at, x, _ in held]).astype(float), np.array([k for *_, k in held]))
    return Identifier(labels, idf, w, model.temperature, bits)


def identify(docs: DataFrame, model: Identifier | None = None, **options) -> DataFrame:
    """Language of every whole text of ``docs`` (columns doc_id, text, lang).

    Returns ``doc_id, held_out, lang_pred, score``. Without ``model`` it is trained on the rows that are not
    held out (crc32 of the id's text, modulo 5, is not 0). Only the text decides a prediction. Null texts and texts without a
    letter are ``und`` with score 0; so is every text if no training row has a language. Repeated rows give
    a row each; an empty table gives an empty one; extra columns are ignored.
    """
    model = train(docs.where(~held_out("doc_id", 5, 0)), **options) if model is None else model

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pred = [model.predict(t) for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p[0] for p in pred], pa.string()), pa.array([p[1] for p in pred], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
