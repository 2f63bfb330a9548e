"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_few, written

BITS = 64
#: Blocks of a fingerprint in the index.
BLOCKS = 4


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def shingle_list(words: Column, width: int) -> Column:
    """64-bit hashes of the ``width``-word shingles in order; empty for fewer words.

    ``words`` is bound to a lambda's variable, so it is worked out once for a row whatever the optimizer merges.
    """
    none = F.array().cast("array<bigint>")

    def hashed(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) >= width, grams).otherwise(none)

    return F.get(F.transform(F.array(words), hashed), F.lit(0))


def prefix_simhashes(own: str, sizes: str, lane_bits: int) -> Column:
    """``(n, fp)`` for each of the ascending ``sizes``: the fingerprint of the first n hashes of ``own``, its bits set in more than half.

    Sums of one bit from each lane of a long are taken together and go on from size to size, so each hash is added up
    once for each lane bit however many sizes there are. A lane holds the count of fewer than ``2 ** (lane_bits - 1)`` hashes.
    """
    ones = sum(1 << lane_bits * j for j in range(BITS // lane_bits))
    part = f"slice({own}, s.at + 1, n - s.at)"
    lanes = f"zip_with(s.lanes, transform(sequence(0, {lane_bits - 1}), k -> aggregate({part}, 0L, (a, h) -> a + (shiftrightunsigned(h, k) & {ones}L))), (x, y) -> x + y)"
    count = f"shiftrightunsigned(l[b % {lane_bits}], cast({lane_bits} * (b div {lane_bits}) as int)) & {(1 << lane_bits) - 1}L"
    bits = f"aggregate(sequence(0, {BITS - 1}), 0L, (a, b) -> a | if(({count}) * 2 > least(n, size({own})), shiftleft(1L, b), 0L))"
    step = f"transform(array({lanes}), l -> named_struct('at', n, 'lanes', l, 'found', concat(s.found, array(named_struct('n', n, 'fp', {bits})))))[0]"
    zero = f"named_struct('at', 0, 'lanes', array_repeat(0L, {lane_bits}), 'found', cast(array() as array<struct<n: int, fp: bigint>>))"
    return F.expr(f"aggregate({sizes}, {zero}, (s, n) -> {step}, s -> s.found)")


def blocks(fp: Column) -> Column:
    """The fingerprint's ``BLOCKS`` blocks, each with its number."""
    size = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, size * i).bitwiseAND(F.lit((1 << size) - 1).cast("long")).alias("value")) for i in range(BLOCKS)])


def block_index(items: DataFrame, radius: int) -> DataFrame:
    """``item_id, n, fp, no, value``: each block's values that differ from the item's in at most ``radius // BLOCKS`` bits.

    Fingerprints within the radius differ in no more bits than that in one of the blocks, so they meet there, and of others
    only a small share does: 4 in 100 for a radius of 15.
    """
    near = F.expr(f"filter(sequence(0L, {(1 << BITS // BLOCKS) - 1}L), x -> bit_count(x) <= {radius // BLOCKS})")
    rows = items.select("item_id", "n", "fp", F.explode(blocks(F.col("fp"))).alias("b"))
    return rows.select("item_id", "n", "fp", "b.no", "b.value", F.explode(near).alias("m")).select("item_id", "n", "fp", "no", F.col("value").bitwiseXOR(F.col("m")).alias("value"))


def near_items(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """``windows`` (n, wfp and others) with ``item_id`` and ``distance`` of all items of n shingles within ``radius`` bits."""
    names = windows.columns
    left = windows.select("*", F.explode(blocks(F.col("wfp"))).alias("b")).select(*names, F.col("b.no").alias("no"), F.col("b.value").alias("value"))
    met = left.join(block_index(items, radius), ["n", "no", "value"])
    distance = F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp")))
    return met.where(distance <= radius).select(*names, "item_id", distance.alias("distance")).distinct()


def _of_width(docs: DataFrame, items: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """``doc_id, item_id, similarity, distance, start`` for items whose shingles have ``width`` words."""
    items = written(items.select("item_id", shingle_list(F.col("words"), width).alias("own")).withColumn("n", F.size("own")))
    most, rows = items.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    lane_bits = 16 if most < 1 << 15 else 32
    grams = written(items.select("item_id", F.explode("own").alias("h")).groupBy("item_id", "h").agg(F.count("*").alias("k")))
    known = items.select("n", F.posexplode("own").alias("at", "h")).groupBy("h").agg(F.collect_set("n").alias("sizes"), F.max(F.col("at") == 0).alias("opens"))
    items = written(items.select("item_id", "n", prefix_simhashes("own", "array(n)", lane_bits).alias("f")).select("item_id", "n", F.col("f")[0]["fp"].alias("fp")))

    # Benchmark shingles in texts, whichever item they are of, and the sizes of items that have them.
    source = docs.select("doc_id", "text")
    text = source.select("doc_id", F.xxhash64("text").alias("key"), word_list(F.col("text")).alias("words"))
    text = text.select("doc_id", "key", shingle_list(F.col("words"), width).alias("all"))
    # A row for each benchmark shingle: broadcast while that is small, else Spark chooses.
    known = F.broadcast(known) if rows <= 1_000_000 else known
    hits = written(text.select("doc_id", "key", F.size("all").alias("size"), F.posexplode("all").alias("pos", "h")).join(known, "h").select("doc_id", "key", "size", "pos", "sizes", "opens"))
    found = written(hits.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct())
    full = source.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")), "left_semi")
    full = full.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), word_list(F.col("text")).alias("words"))
    full = written(full.select("d", "k", shingle_list(F.col("words"), width).alias("all")).dropDuplicates(["d", "k"]))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))

    # Item-sized windows, from where a run of benchmark shingles begins and where the first shingle of an item stands.
    before = F.lag("pos").over(Window.partitionBy("doc_id", "key").orderBy("pos"))
    anchors = hits.withColumn("before", before).where("opens or before is null or before < pos - 1")
    start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - F.col("n")))
    starts = anchors.select("doc_id", "key", "size", "pos", F.explode("sizes").alias("n")).select("doc_id", "key", start.alias("start"), "n")
    starts = starts.groupBy("doc_id", "key", "start").agg(F.array_sort(F.collect_set("n")).alias("sizes"))
    windows = starts.join(full, same).select("doc_id", "key", "start", "sizes", F.slice("all", F.col("start") + 1, F.array_max("sizes")).alias("own"))
    windows = windows.select("doc_id", "key", "start", F.explode(prefix_simhashes("own", "sizes", lane_bits)).alias("f"))
    windows = written(windows.select("doc_id", "key", "start", F.col("f.n").alias("n"), F.col("f.fp").alias("wfp")))

    near = near_items(windows, items, radius)

    # Exact similarity: shingles count as often as they occur.
    by = ("doc_id", "key", "item_id", "start", "n", "distance")
    shingles = near.join(full, same).select(*by, F.slice("all", F.col("start") + 1, F.col("n")).alias("own"))
    shingles = shingles.select(*by, F.size("own").alias("size"), F.explode("own").alias("h"))
    counted = shingles.groupBy(*by, "size", "h").agg(F.count("*").alias("m"))
    shared = counted.join(grams, ["item_id", "h"]).groupBy(*by, "size").agg(F.sum(F.least("m", "k")).alias("shared"))
    score = F.col("shared") / (F.col("n") + F.col("size") - F.col("shared"))
    return shared.withColumn("similarity", score).where(F.col("similarity") >= similarity).select("doc_id", "key", "item_id", "similarity", "distance", "start")


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 15, by_text: bool = False) -> DataFrame:
    """Which of ``docs`` (doc_id, text) hold a passage like an item of ``items`` (item_id, text).

    Returns a row for each such document and item: ``doc_id, item_id, similarity, distance, start``: of its best
    window the weighted Jaccard similarity of ``width``-word shingles (each weighs as often as it occurs), the
    fingerprints' differing bits, and the window's first word (of equal ones the first). With ``by_text`` documents are told apart
    by id and text, whose hash is ``key``.

    Windows have as many shingles as an item (or all of a shorter text) and begin at a benchmark shingle that follows
    none or that opens an item. The index of blocks finds all items of a window's size whose fingerprints differ from the
    window's in at most ``radius`` bits, and only these pairs are compared exactly. (At similarity 0.8, shingles in
    common of 8/9, 10 bits differ on average and more than 15 in 3 of 100 pairs; at 0.9 in 1 of 10,000; equal passages differ
    in none.) Items of fewer words than ``width``
    are one shingle and match where all of it occurs. Null, empty and wordless texts and items match nothing.
    Rows that share an id count as one document; a null id is an id. Empty tables give an empty one; extra
    columns are ignored, whatever their names.
    """
    items = written(items.select("item_id", word_list(F.col("text")).alias("words")).where("size(words) > 0"))
    sizes = F.least(F.size("words"), F.lit(width))
    widths = sorted(r[0] for r in items.select(sizes.alias("w")).distinct().collect())  # at most ``width`` numbers
    found = None
    for w in widths or [width]:
        part = _of_width(docs, items.where(sizes == w), w, similarity, radius)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))).alias("b")
    by = ["doc_id", "key", "item_id"] if by_text else ["doc_id", "item_id"]
    return found.groupBy(*by).agg(best).select(*by, F.col("b.similarity").alias("similarity"), (-F.col("b.d")).alias("distance"), (-F.col("b.s")).alias("start"))


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns, whatever their names.

    Rows are told apart by id and text: a leak in one has no say on others that share its id or have none. Empty tables lose no row."""
    bad = written(find_leaks(docs, items, by_text=True, **options).select("doc_id", "key").distinct())
    return docs.join(if_few(bad), docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["key"]), "left_anti")
