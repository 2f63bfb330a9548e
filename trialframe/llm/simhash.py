"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import fresh, if_few, map_texts, spread_join, written
from .components import connected_components

#: Each lane of 8 bits counts one bit of a byte position; 255 shingles fit before lanes overflow.
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of ``text`` (A-Z lower-cased, words joined by one space)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[-n:].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(start, end)], np.uint64)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Bits that are set in more than half of the shingles' hashes, as a signed 64-bit integer.

    A null, empty or blank text has no shingle and fingerprint 0; a text of fewer than ``width`` words has
    one shingle, the whole sequence.
    """
    h = shingle_hashes(text or b"", width, seed)
    if not len(h):
        return 0
    full = len(h) // 255 * 255
    count = np.zeros((8, 8), np.int64)
    for k in range(8):
        lane = (h >> np.uint64(k)) & LANES
        if full:
            count[k] += lane[:full].reshape(-1, 255).sum(1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        if full < len(h):
            count[k] += lane[full:].sum(dtype=np.uint64).reshape(1).view(np.uint8).astype(np.int64)
    bits = (count * 2 > len(h)).astype(np.uint64)
    place = np.arange(8, dtype=np.uint64)
    out = (bits << (place[None, :] * np.uint64(8) + place[:, None])).sum(dtype=np.uint64)
    return int(out.reshape(1).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, key, fp`` (the text's hash and its fingerprint as a signed long) for every row of ``docs``; other columns are not read."""
    kind = docs.schema[id_col].dataType

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint(t, width) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], ["doc_id", "key", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(text_col)).alias("key"))
    return map_texts(src, run, f"doc_id {kind.simpleString()}, key long, fp long")


def position_sets(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` of the 8 positions are the union of those that they contain."""
    left = {(x, p) for x in combinations(range(8), shared) for p in x}
    out = []
    while left:
        best = max(combinations(range(8), width), key=lambda s: sum(p in s and set(s) <= set(x) for x, p in left))
        out.append(best)
        left = {(x, p) for x, p in left if not (p in best and set(best) <= set(x))}
    return out


def byte_at(c: Column, p: int) -> Column:
    return F.shiftrightunsigned(c, 8 * p).bitwiseAND(F.lit(255))


def near_pairs(fps: DataFrame, radius: int = 3, index_bytes: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` of ``fps`` that differ in 1 to ``radius`` bits.

    ``radius`` differing bits touch at most ``radius`` bytes, so such pairs share at least ``8 - radius`` of
    their 8 positional bytes. The inverted index has a posting list for each value of certain sets of
    positions, which stay short where the list of one byte would hold 1/256 of all fingerprints. A pair that meets in a list
    shares the bytes of its set. These bytes are tallied per pair over all lists; since any ``8 - radius``
    positions are the union of the sets in them, a pair in the radius tallies that many or more. Pairs that
    reach this minimum are verified by their differing bits. ``index_bytes`` (the size of a set) follows from
    the number of fingerprints: the results are the same for each, only list lengths differ.
    """
    if not 0 < radius < 6:
        raise ValueError("radius must be 1 to 5")
    shared = 8 - radius
    if index_bytes is None:
        n = fps.count()
        index_bytes = min(shared, 3 if n <= 1 << 24 else 4 if n <= 1 << 32 else 5)
    # ``list`` is the set of positions as bits.
    keys = [
        F.struct(F.lit(sum(1 << p for p in s)).alias("list"), sum((byte_at(F.col("fp"), p) * (1 << 8 * k) for k, p in enumerate(s)), F.lit(0).cast("long")).alias("key"))
        for s in position_sets(shared, min(shared, index_bytes))
    ]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.list", "k.key")
    a, b = F.col("x.fp"), F.col("y.fp")
    met = index.alias("x").join(index.alias("y"), (F.col("x.list") == F.col("y.list")) & (F.col("x.key") == F.col("y.key")) & (a < b))
    tally = met.groupBy(a.alias("a"), b.alias("b")).agg(F.bit_count(F.bit_or("x.list")).alias("bytes")).where(F.col("bytes") >= shared)
    return tally.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest non-null id that can be reached over links of at most ``radius``
    differing bits, the row's own included; null if there is none. Rows of equal fingerprints form one
    class, so copies are never paired with each other. Repeated ids give a row each. Null and empty texts
    have fingerprint 0. An empty table gives an empty one. Extra columns of ``docs`` are ignored.
    """
    rows, named = _classes(docs, id_col, text_col, width, radius)
    out = spread_join(rows, written(named.select("fp", "n", "least")), "fp", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, fp`` of each row (``key`` is the text's hash), and of each fingerprint ``fp, root, n`` rows,
    and of its component ``least`` id and ``first`` (id and key of the row that stands for it)."""
    rows = written(fingerprints(docs, id_col, text_col, width))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    classes = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(row).alias("first")))
    roots = connected_components(near_pairs(classes, radius))
    linked = roots.select(F.col("node").alias("fp"), "root")
    named = classes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first").alias("first"))
    return rows, named.select("fp", "n", "root").join(best, "root").withColumn("least", F.col("first.doc_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one document, that with the smallest id.

    Rows are told apart by id and text: of rows with the same id one stays for each component (the first by the text's hash),
    and of rows that agree in both one. Rows with a null id can't be named by a component: they stay, but
    equal texts among them only once. Columns are those of ``docs``, whatever their names. An empty table gives an empty one.
    """
    rows, named = _classes(docs, id_col, text_col, width, radius)
    keep = named.where("first is not null").select("first").distinct().select("first.*")
    keep = written(keep.unionByName(rows.where("doc_id is null").select("doc_id", "key").distinct()))
    same = docs[id_col].eqNullSafe(keep["doc_id"]) & (F.xxhash64(docs[text_col]) == keep["key"])
    stay = docs.join(if_few(keep), same, "left_semi")
    twice = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").join(keep, ["key"], "left_semi")
    if twice.isEmpty():
        return stay
    own = fresh(docs, "key")
    return stay.withColumn(own, F.xxhash64(text_col)).dropDuplicates([id_col, own]).drop(own)
