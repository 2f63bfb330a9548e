"""Substring dedup: repeated paragraphs and passages by MinHash banding, exact verification and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, n_tasks, small_batches, written
from .components import connected_components

U = np.uint64
_Q = U(0x9E3779B97F4A7C15)
_Q_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MAX = U((1 << 64) - 1)
#: Code points that are worked on together; a longer text is worked on alone.
BATCH_CHARS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out)


class Words:
    """Words of a text (runs without ASCII white space, A-Z lower-cased): offsets in code points, lines, hashes."""

    def __init__(self, text: str):
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        n = self.end - self.start
        if not len(n):
            self.line, self.hash = np.empty(0, np.int64), np.empty(0, U)
            return
        low = cp[inside].astype(U)
        low = np.where((low >= 65) & (low <= 90), low + U(32), low)
        first = np.cumsum(n) - n
        place = np.arange(len(low)) - np.repeat(first, n)
        self.hash = mix(np.add.reduceat(mix(low + U(1)) * _powers(_Q, int(n.max()))[place], first) + n.astype(U))
        self.line = np.cumsum(cp == 10)[self.start]


def _slide(h: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (np.minimum or np.maximum) over each ``width`` neighbouring values."""
    done = 1
    out = h
    while done < width:
        step = min(done, width - done)
        out = take(out[: len(out) - step], out[step:])
        done += step
    return out


class Grams:
    """Runs of ``width`` words inside each text of ``w``: ``at`` (first word), ``cls`` (hash), ``text`` (number), ``place`` in the text."""

    def __init__(self, w: Words, text: np.ndarray, width: int):
        n = len(w.hash)
        self.total = np.concatenate([np.zeros(1, U), np.cumsum(w.hash * _powers(_Q, n), dtype=U)])
        self.back = _powers(_Q_INVERSE, n)
        at = np.arange(max(0, n - width + 1))
        self.at = at[text[at] == text[at + width - 1]]
        self.text = text[self.at]
        new = np.diff(self.text, prepend=-1) != 0
        first = np.flatnonzero(new)
        self.place = np.arange(len(self.at)) - first[np.cumsum(new) - 1] if len(first) else self.at
        self.number = np.diff(np.append(first, len(self.at)))  # of each text that has any
        self.cls = self.of(self.at, self.at + width)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``begin`` up to ``end``."""
        return mix((self.total[end] - self.total[begin]) * self.back[begin] + (end - begin).astype(U))

    def chosen(self, window: int) -> np.ndarray:
        """Whether each run's hash is the least of some ``window`` neighbouring runs of its text (of all, if there are fewer).

        The choice depends on those runs alone, so of any ``window`` neighbouring runs that two texts share one is chosen in both.
        """
        if not len(self.at):
            return np.zeros(0, bool)
        text = np.repeat(np.arange(len(self.number)), self.number)
        spot = np.arange(len(self.at)) + window * (text + 1)
        wide = np.full(spot[-1] + window, _MAX, U)
        wide[spot] = self.cls
        least = _slide(wide, window, np.minimum)
        whole = np.zeros(len(wide), U)
        ok = self.place <= np.maximum(self.number[text] - window, 0)
        whole[spot[ok]] = least[spot[ok]]
        return self.cls == _slide(whole, window, np.maximum)[spot - window + 1]


def units(text: str, first: np.ndarray, width: int = 5, rows: int = 3, bands: int = 8, whole_words: int = 5, run: int = 25, surely: int = 51):
    """Paragraphs of texts and chosen runs of their words, as columns (start, end, at, n_words, class, bands or None).

    ``text`` is texts that begin at ``first``, with a line end between them. A paragraph is a line, whatever its length; those of
    ``whole_words`` words or more have MinHash bands. Runs have ``run`` words and may cross lines; they are chosen (winnowed) such that
    every passage of ``surely`` words or more that two texts share holds one that is chosen in both. ``at`` counts words of the own text.
    """
    w = Words(text)
    n = len(w.hash)
    if not n:
        return None
    own = np.searchsorted(first, w.start, side="right") - 1
    new_text = np.diff(own, prepend=-1) != 0
    at = np.arange(n) - np.flatnonzero(new_text)[np.cumsum(new_text) - 1]
    begin = np.flatnonzero(np.diff(w.line, prepend=-1) != 0)
    whole = np.stack([begin, np.append(begin[1:], n)], 1)
    grams = Grams(w, own, run)
    begin = grams.at[grams.chosen(surely - run + 1)]
    both = np.concatenate([whole, np.stack([begin, begin + run], 1)])
    size = both[:, 1] - both[:, 0]
    cls = grams.of(both[:, 0], both[:, 1])
    # A paragraph of as many words as a run is told apart from the run in the same place.
    cls[: len(whole)] = np.where(size[: len(whole)] == run, mix(cls[: len(whole)] + U(1)), cls[: len(whole)])
    keys = np.zeros((len(both), bands), np.int64)
    banded = np.zeros(len(both), bool)
    banded[: len(whole)] = whole[:, 1] - whole[:, 0] >= max(whole_words, width)
    if banded.any():
        long = both[banded]
        shingle = shingles(w.hash, width)
        count = long[:, 1] - long[:, 0] - width + 1
        begin = np.cumsum(count) - count
        take = np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(long[:, 0], count)
        s = shingle[take]
        for b in range(bands):
            key = np.full(len(long), b, U)
            for r in range(rows):
                salt = mix(np.array([b * rows + r + 1], U))
                key = mix(key * _Q + np.minimum.reduceat((s ^ salt) * U(0xD6E8FEB86659FD93) >> U(16), begin))
            keys[banded, b] = key.view(np.int64)
    is_whole = np.arange(len(both)) < len(whole)
    return w.start[both[:, 0]], w.end[both[:, 1] - 1], at[both[:, 0]], size, cls.view(np.int64), is_whole, banded, keys


def contexts(text: str, runs: list[tuple[int, bool, bool]], run: int, reach: int) -> list[tuple[int, bool, bytes, bytes]]:
    """The words beside runs of a text: (place in ``runs``, right side, words' hashes going away from the run, their outer offsets).

    ``runs`` are (first word, left side wanted, right side wanted). There are ``reach`` words on a side, fewer at the text's ends.
    """
    w = Words(text)
    short = (w.hash >> U(32)).astype(">u4")
    out = []
    for i, (at, left, right) in enumerate(runs):
        if left and at:
            side = slice(max(0, at - reach), at)
            out.append((i, False, short[side][::-1].tobytes(), w.start[side][::-1].astype("<i4").tobytes()))
        if right and at + run < len(short):
            side = slice(at + run, at + run + reach)
            out.append((i, True, short[side].tobytes(), w.end[side].astype("<i4").tobytes()))
    return out


def common_words(a: bytes, b: bytes) -> int:
    """How many 4-byte words two contexts begin with together."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n))
    return int(differ[0]) if len(differ) else n


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    out = np.zeros(max(0, n), U)
    for j in range(width):
        out = out * U(0x100000001B3) + h[j : j + max(0, n)]
    return mix(out)


def find_units(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, key, start, end, at, n_words, class, whole, bands`` of the units of each row of ``docs``; ``key`` is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols, part, size = [], [], [], 0
            texts = b.column(2).to_pylist()
            for i, t in enumerate(texts):
                if t:
                    part.append((i, t))
                    size += len(t) + 1
                if part and (size > BATCH_CHARS or i + 1 == len(texts)):
                    # Units never cross texts, so these can be joined by a line end and worked on together.
                    first = np.cumsum([0, *(len(t) + 1 for _, t in part[:-1])])
                    found = units("\n".join(t for _, t in part), first, **options)
                    if found:
                        own = np.searchsorted(first, found[0], side="right") - 1
                        at.append(np.array([i for i, _ in part])[own])
                        cols.append((found[0] - first[own], found[1] - first[own], *found[2:]))
                    part, size = [], 0
            if not cols:
                continue
            rows = pa.array(np.concatenate(at))
            start, end, word, n, cls, whole, banded, keys = (np.concatenate([c[k] for c in cols]) for k in range(8))
            offsets = np.concatenate([[0], np.cumsum(banded * keys.shape[1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(cls), pa.array(whole), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[banded].ravel()))],
                ["doc_id", "key", "start", "end", "at", "n_words", "class", "whole", "bands"],
            )

    small_batches(docs.sparkSession)
    src = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return src.mapInArrow(run, f"doc_id {kind}, key long, start int, end int, at int, n_words int, class long, whole boolean, bands array<long>")


def seen_before(rows: DataFrame, classes: DataFrame, most_bits: int = 26) -> DataFrame:
    """Those of ``rows`` whose ``class`` may be in ``classes``: all that are, and few others.

    Classes set bits of one bitmap, at least 16 bits for each up to ``2 ** most_bits`` (8 MB, whatever the input), which is
    broadcast; beyond that more others pass. The caller joins exactly; this spares that join most rows.
    """
    bits = max(12, min(most_bits, (16 * max(1, classes.count()) - 1).bit_length()))

    def spots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = values.view(U) >> U(64 - bits)
        return (place >> U(6)).astype(np.int64), place & U(63)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits - 6, U)
        for b in batches:
            word, bit = spots(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(table, word, U(1) << bit)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["w", "b"])

    words = classes.select("class").mapInArrow(mark, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << bits - 6, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    known = rows.sparkSession.sparkContext.broadcast(table)
    own = rows.columns.index("class")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = spots(b.column(own).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array((known.value[word].view(U) >> bit & U(1)).astype(bool)))

    return rows.mapInArrow(keep, rows.schema)


def extended(sides: DataFrame, run: int) -> DataFrame:
    """``key, at, n_words, start, end, class`` of runs made longer by what their ``sides`` share with others of their class.

    In the order of class and context the longest common context of a row is that with one of its two neighbours. Rows are
    range-sorted and each range is walked once; the rows at the ranges' ends, two a task, are compared on the driver.
    """
    by = ("right", "class", "words")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared, first = None, 0, True
        for b in batches:
            out = []
            for row in b.to_pylist():
                if held is not None:
                    same = common_words(held["words"], row["words"]) if (held["right"], held["class"]) == (row["right"], row["class"]) else 0
                    out.append({**held, "shared": max(shared, same), "edge": first})
                    first, shared = False, same
                held = row
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{**held, "shared": shared, "edge": True}], schema)

    schema = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("class", pa.int64()), ("right", pa.bool_()), ("words", pa.binary()), ("offsets", pa.binary()), ("shared", pa.int32()), ("edge", pa.bool_())])
    sides = sides.select("key", "at", "start", "end", "class", "right", "words", "offsets")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sides.schema) + ", shared int, edge boolean"
    rows = written(sides.repartitionByRange(n_tasks(sides.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(walk, kinds))
    ends = sorted((r.asDict() for r in rows.where("edge").collect()), key=lambda r: (r["right"], r["class"], bytes(r["words"])))
    more = []
    for a, b in zip(ends, ends[1:]):
        if (a["right"], a["class"]) == (b["right"], b["class"]) and (a["key"], a["at"]) != (b["key"], b["at"]):
            same = common_words(a["words"], b["words"])
            more += [{**r, "shared": same} for r in (a, b) if same > r["shared"]]
    if more:
        rows = rows.unionByName(rows.sparkSession.createDataFrame([tuple(r[c] for c in rows.columns) for r in more], rows.schema))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                k, end = r["shared"], int(np.frombuffer(r["offsets"], "<i4")[r["shared"] - 1])
                out.append((r["key"], r["at"] - (0 if r["right"] else k), run + k, r["start"] if r["right"] else end, end if r["right"] else r["end"], r["class"], r["at"]))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["key", "at", "n_words", "start", "end", "class", "base"])

    return rows.where("shared > 0").mapInArrow(spans, "key long, at int, n_words int, start int, end int, class long, base int")


def repeated_runs(found: DataFrame, docs: DataFrame, run: int, surely: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Units ``key, at, n_words, start, end, class, base`` of all repeated runs, made as long as their copies agree, and their
    classes ``class, n, first``: how many places they have and the first; and the tables that these read.

    Equal texts are worked on once, with the number of rows that have them. A text's runs of one class that overlap are one place
    (``base`` is the first of them), so that a text that repeats one word is no copy of itself. A run is made longer on a side unless
    all places of its class are followed there by the same overlapping run: what they share then shows at that run.
    """
    runs = found.where("not whole").select("doc_id", "key", "start", "end", "at", "class")
    again = written(runs.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"))
    hits = seen_before(runs, again).join(again, "class").groupBy("key", "at", "start", "end", "class").agg(F.count("*").alias("m"), F.min("doc_id").alias("doc"))
    raw = written(hits)
    text, own = Window.partitionBy("key").orderBy("at"), Window.partitionBy("key", "class").orderBy("at")
    hits_at = raw.repartition("key")
    gap, ahead = F.col("at") - F.lag("at").over(own), F.lead("at").over(own) - F.col("at")
    hits_at = hits_at.withColumn("head", F.coalesce(gap >= run, F.lit(True))).withColumn("tail", F.coalesce(ahead >= run, F.lit(True)))
    hits_at = hits_at.withColumn("base", F.last(F.when(F.col("head"), F.col("at")), ignorenulls=True).over(own))

    def beside(step) -> Column:
        far = F.abs(step("at").over(text) - F.col("at"))
        return F.when(far <= run, F.struct(step("class").over(text).alias("c"), far.alias("d")))

    hits_at = written(hits_at.withColumn("left", beside(F.lag)).withColumn("right", beside(F.lead)))

    def parted(end: str, side: str) -> Column:
        value = F.when(F.col(end), F.col(side))
        return (F.count_if(F.col(end) & F.col(side).isNull()) > 0) | (F.min(value) != F.max(value))

    classes = hits_at.groupBy("class").agg(
        F.sum(F.when(F.col("head"), F.col("m")).otherwise(0)).alias("n"), F.min(F.struct("doc", "key", F.col("base").alias("at"))).alias("first"),
        parted("head", "left").alias("open_left"), parted("tail", "right").alias("open_right"),
    ).where("n > 1")
    classes = written(classes)
    forget(again)
    hits = written(hits_at.drop("left", "right", "m").join(classes.select("class", "open_left", "open_right"), "class"))
    forget(raw)
    forget(hits_at)
    wanted = hits.withColumn("l", F.col("head") & F.col("open_left")).withColumn("r", F.col("tail") & F.col("open_right")).where("l or r")
    wanted = written(wanted.groupBy("key", F.col("doc").alias("_d")).agg(F.collect_list(F.struct("at", "l", "r", "start", "end", "class")).alias("runs")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_key"), "text")
    src = src.join(wanted, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("key"))).dropDuplicates(["_doc", "_key"]).select("key", "text", "runs")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, found_runs in zip(*(b.column(i).to_pylist() for i in range(3))):
                for i, right, words, offsets in contexts(text, [(r["at"], r["l"], r["r"]) for r in found_runs], run, surely - run + 1):
                    r = found_runs[i]
                    out.append((key, r["at"], r["start"], r["end"], r["class"], right, words, offsets))
            cols = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "at", "start", "end", "class", "right", "words", "offsets"])

    made = written(src.mapInArrow(sides, "key long, at int, start int, end int, class long, right boolean, words binary, offsets binary"))
    longer = extended(made, run)
    # The place of a longer run is that of the run it grew from.
    longer = longer.withColumnRenamed("base", "_at").join(hits.select(F.col("key").alias("_k"), F.col("at").alias("_a"), F.col("class").alias("_c"), "base"), (F.col("key") == F.col("_k")) & (F.col("_at") == F.col("_a")) & (F.col("class") == F.col("_c")))
    columns = ("key", "at", "n_words", "start", "end", "class", "base")
    out = hits.withColumn("n_words", F.lit(run)).select(*columns).unionByName(longer.select(*columns))
    forget(wanted)
    return out, classes.select("class", "n", "first"), [hits, classes, made]


def sketch(members: np.ndarray) -> list[int]:
    """256 bits, each the parity of how many of the distinct ``members`` hash to it: where two sets' sketches
    differ in n bits, at least n members are in one set only."""
    bits = np.bincount(((members * _Q) >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def shingle_sets(docs: DataFrame, where: DataFrame, width: int) -> DataFrame:
    """``class, set, bits`` of the paragraphs of ``where`` (class, doc_id, key, start, end), read from ``docs`` again."""
    own = where.select("class", F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    src = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))
    src = src.select("class", F.substring("text", F.col("_s") + 1, F.col("_e") - F.col("_s")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(Words(t).hash, width)) for t in b.column(1).to_pylist()]
            bits = pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64).tolist() for x in sets], pa.list_(pa.int64())), bits], ["class", "set", "bits"])

    return src.mapInArrow(run, "class long, set array<long>, bits array<long>").dropDuplicates(["class"])


def _may_be_similar(s: str, t: str, similarity: float) -> Column:
    """No less than the truth: sets of sizes m and n that are ``similarity`` alike differ in (m + n) (1 - s) / (1 + s) members at most."""
    differ = sum((F.bit_count(F.col(f"{s}.bits")[i].bitwiseXOR(F.col(f"{t}.bits")[i])) for i in range(4)), F.lit(0))
    return differ <= (F.col(f"{s}.members") + F.col(f"{t}.members")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose exact Jaccard similarity is at least ``similarity``."""
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("x")), sets.select(F.col("class").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_links(found: DataFrame, docs: DataFrame, width: int, similarity: float, all_pairs_to: int = 16) -> DataFrame:
    """Links ``a, b`` that join the near-duplicate paragraph classes of ``found`` into components.

    Classes meet in the buckets of their bands. A pair is made only if the classes' sketches allow the similarity, which
    leaves out no similar pair; made pairs are verified exactly. In buckets of more than ``all_pairs_to`` classes each is first
    compared with the class of most copies, and then only pairs that are still in different components are made:
    that loses no link between components and emits no group's pairs.
    """
    par = found.where("size(bands) > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min_by(F.struct("doc_id", "key", "start", "end", "bands"), F.struct("doc_id", "key", "start")).alias("r")).select("class", "copies", "r.*")
    par = written(par)
    index = par.select("class", "copies", F.explode("bands").alias("band"))
    size = index.groupBy("band").agg(F.count("*").alias("n"), F.max(F.struct("copies", "class")).alias("top")).where("n > 1").select("band", "n", F.col("top.class").alias("hub"))
    index = written(index.join(size, "band"))
    sets = written(shingle_sets(docs, par.join(index.select("class").distinct(), "class"), width))
    sketches = sets.select("class", "bits", F.size("set").alias("members"))
    index = written(index.join(sketches, "class").select("band", "class", "n", "hub", "bits", "members"))
    small, large = index.where(F.col("n") <= all_pairs_to), index.where(F.col("n") > all_pairs_to)
    likely = _may_be_similar("s", "t", similarity)
    ordered = (F.least("s.class", "t.class").alias("a"), F.greatest("s.class", "t.class").alias("b"))
    pairs = small.alias("s").join(small.alias("t"), (F.col("s.band") == F.col("t.band")) & (F.col("s.class") < F.col("t.class")) & likely).select(*ordered)
    hubs = large.where(F.col("class") == F.col("hub"))
    star = large.alias("s").join(hubs.alias("t"), (F.col("s.band") == F.col("t.band")) & (F.col("s.class") != F.col("t.class")) & likely).select(*ordered)
    links = written(_verified(pairs.union(star).distinct(), sets, similarity))
    if large.isEmpty():
        return links
    root = connected_components(links)
    named = written(large.join(root, large["class"] == root["node"], "left").select("band", "class", "bits", "members", F.coalesce("root", "class").alias("root")))
    rest = named.alias("s").join(named.alias("t"), (F.col("s.band") == F.col("t.band")) & (F.col("s.root") < F.col("t.root")) & likely).select(*ordered)
    return links.union(_verified(rest.distinct(), sets, similarity))


def tuned_bands(similarity: float, recall: float = 0.995, rows: int = 3) -> int:
    """The fewest bands of ``rows`` MinHashes that let pairs of ``similarity`` meet with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def repeated_passages(docs: DataFrame, width: int = 5, similarity: float = 0.8, least_run: int = 25, rows: int = 3, recall: float = 0.995, surely: int = 51) -> DataFrame:
    """Passages of ``docs`` (columns doc_id, text) that repeat: one row for each passage and place.

    Returns ``doc_id, start, end`` (code points), ``n_words, cluster_id, copies, removed``. Units are paragraphs of any length and
    runs of ``least_run`` words. Equal units (by 64-bit hash of their lower-cased words) are one class;
    paragraphs of different classes are joined where the Jaccard similarity of their ``width``-word shingles is at least ``similarity``
    (as many bands of ``rows`` MinHashes as find ``recall`` of the pairs at that similarity, and more above). Components of classes
    are clusters; a cluster with two or more places repeats. Every passage of ``surely`` words or more that two places share word
    by word is found, wherever it stands, and from its first word to its last (see ``units`` and ``repeated_runs``); of those of
    ``least_run`` words or more some are. Equal texts are one passage each. Repeated units that touch or overlap form a passage.
    ``cluster_id`` is the smallest id of a document that holds a unit of its clusters; ``removed`` is true unless all its units are
    the first of their clusters (by id, then text hash and place), which stay. Null and empty texts have no passage. Rows that share an id and
    text count as places each. A null id is an id. An empty table gives an empty one; extra columns are ignored.
    """
    found = written(find_units(docs, width=width, rows=rows, bands=tuned_bands(similarity, recall, rows), run=least_run, surely=surely))
    links = near_links(found, docs, width, similarity)
    root = connected_components(links).select(F.col("node").alias("class"), "root")
    columns = ("key", "at", "n_words", "start", "end", "class", "base")
    runs, run_classes, used = repeated_runs(found, docs, least_run, surely)
    lines = written(found.where("whole").groupBy("key", "at", "n_words", "start", "end", "class").agg(F.count("*").alias("m"), F.min("doc_id").alias("doc")))
    line_classes = lines.groupBy("class").agg(F.sum("m").alias("n"), F.min(F.struct("doc", "key", "at")).alias("first"))
    texts = lines.groupBy("key").agg(F.max("m").alias("n"), F.min("doc").alias("doc"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").cast("int").alias("n_words"))
    texts = written(texts.withColumn("class", F.hash("key").cast("long")).withColumn("at", F.lit(0)).withColumn("base", F.lit(0)))
    equal = texts.where("n > 1")
    per = run_classes.unionByName(line_classes).join(root, "class", "left").where("n > 1 or root is not null")
    per = written(per.withColumn("root", F.coalesce("root", "class")))
    cluster = per.groupBy("root").agg(F.sum("n").alias("copies"), F.min("first").alias("first")).where("copies > 1")
    named = per.select("class", "root").join(cluster, "root").select("class", "copies", "first")
    every = runs.unionByName(lines.withColumn("base", F.col("at")).select(*columns)).join(named, "class")
    every = every.unionByName(equal.select(*columns, F.col("n").alias("copies"), F.struct("doc", "key", "at").alias("first")))
    every = every.join(texts.select(F.col("key").alias("_k"), "doc"), F.col("key") == F.col("_k")).drop("_k")
    hit = written(every.withColumn("keeper", F.col("first").eqNullSafe(F.struct("doc", "key", F.col("base").alias("at")))))
    for table in (found, lines, texts, per, *used):
        forget(table)
    by = Window.partitionBy("key").orderBy("at", F.desc("n_words"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("reach", F.coalesce(F.max(F.col("at") + F.col("n_words")).over(before), F.lit(-9)))
    hit = hit.withColumn("run", F.sum((F.col("at") > F.col("reach")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = hit.groupBy("key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("n_words")) - F.min("at")).alias("n_words"),
        F.min("first.doc").alias("cluster_id"), F.max("copies").alias("copies"), F.min("keeper").alias("keeper"), F.min("doc").alias("doc"),
    )
    places = docs.select("doc_id", F.xxhash64("text").alias("_key"))
    out = places.join(written(out), F.col("_key") == F.col("key"))
    stays = F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("doc"))
    return out.select("doc_id", "start", "end", "n_words", "cluster_id", "copies", (~stays).alias("removed"))
