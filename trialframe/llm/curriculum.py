"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, n_tasks, written

WEIGHTS = (3, 1, 2)
#: Relative rate of a source over training time 0 to 1, as (time, rate) knots joined by straight lines; the
#: n-th source in order takes the n-th schedule, repeating. Each is scaled to the source's target.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(share before, share after, start time, start rate, slope) of each piece, with shares that sum to 1."""
    pieces = list(zip(knots, knots[1:]))
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    if knots[0][0] != 0 or knots[-1][0] != 1 or total <= 0 or any(r < 0 for _, r in knots) or any(a[0] >= b[0] for a, b in pieces):
        raise ValueError("knots must run from time 0 to 1 with rates of at least 0, not all 0")
    out, before = [], 0.0
    for a, b in pieces:
        after = before + (b[0] - a[0]) * (a[1] + b[1]) / 2 / total
        out.append((before, after, a[0], a[1] / total, (b[1] - a[1]) / (b[0] - a[0]) / total))
        before = after
    return out


def time_of(share: Column, order: Column, schedules: Sequence = SCHEDULES) -> Column:
    """Training time at which a source has delivered ``share`` of its target: the inverse of its integrated
    schedule, a quadratic in each piece. ``order`` is the source's number from 0."""

    def inverse(knots: Sequence[tuple[float, float]]) -> Column:
        out = F.lit(1.0)
        for before, after, t, rate, slope in reversed(segments(knots)):
            more = share - F.lit(before)
            root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * more, F.lit(0.0)))
            # rate*x + slope*x*x/2 = more, solved so that a slope of 0 is no special case
            step = F.coalesce(F.try_divide(2 * more, F.lit(rate) + root), F.lit(0.0))
            out = F.when(share < F.lit(after), F.lit(t) + step).otherwise(out)
        return out

    out = inverse(schedules[-1])
    for i in reversed(range(len(schedules) - 1)):
        out = F.when(order % len(schedules) == i, inverse(schedules[i])).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = 150, cap: int = 2) -> DataFrame:
    """``source, n_rows, source_size, order, target`` of each source.

    ``total_percent`` of all sizes is shared by weight; a source stops at ``cap`` times its size and the
    excess goes to the others by weight. That is the same as one level: the target is the lesser of
    the cap and weight times level. Sources are sorted by how soon they reach their cap; sums over that
    order give the level. The table has a row for each source, already added up, so one task may sort it.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("order", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("order") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", (cap * F.col("source_size")).cast("double")).withColumn("goal", F.sum("source_size").over(every) * F.lit(total_percent) / 100.0)
    ahead = Window.orderBy(F.col("most") / F.col("weight"), "order")
    per = per.withColumn("capped", F.coalesce(F.sum("most").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(ahead.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("goal") - F.col("capped")) / F.col("open")
    # The first source in that order which stays below its cap sets the level for it and all behind it.
    per = per.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("order"), level.alias("level")))).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return per.select("source", "n_rows", "source_size", "order", target.alias("target"))


def _placed(
    docs: DataFrame, size: Column | None = None, weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES,
    total_percent: int = 150, cap: int = 2, rows_per_bucket: int = 1000, whole: bool = False,
) -> DataFrame:
    """What ``curriculum`` returns, in no order, and with ``whole`` all columns of ``docs`` as ``row``."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") if size is None else size
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select("doc_id", "source", *([F.struct(*docs.columns).alias("row")] if whole else []), size.alias("size"), key.alias("key"))
    light = written(rows.select("source", "size", "key"))
    plan = written(targets(light, weights, total_percent, cap))
    pieces = F.ceil(F.col("n_rows") / F.lit(rows_per_bucket)).cast("double")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    some = plan.withColumnRenamed("source", "_s")

    def placed(rows: DataFrame) -> DataFrame:
        # A row for each source: broadcast while they are few.
        return rows.join(F.broadcast(some) if few else some, rows["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumn("piece", F.floor(place * pieces))

    few = plan.count() <= 10_000
    ahead = Window.partitionBy("order").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed(light).groupBy("order", "piece").agg(F.sum("size").alias("words"))
    sums = written(sums.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words"))
    forget(light)
    rows = placed(rows).join(sums, ["order", "piece"])
    inside = Window.partitionBy("order", "piece").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = F.col("start") + F.col("size") / 2.0
    copies = sum(((middle + F.lit(k) * F.col("source_size") < F.col("target")).cast("int") for k in range(cap)), F.lit(0))
    shares = [F.coalesce(F.try_divide((F.col("start") + F.lit(k) * F.col("source_size")).cast("double"), F.col("target")), F.lit(0.0)) for k in range(cap)]
    out = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))
    times = F.array(*(time_of(share, F.col("order"), schedules) for share in shares))
    out = out.withColumn("positions", F.slice(times, F.lit(1), F.col("copies"))).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "position", "positions", *(["row"] if whole else []))


def _sorted(out: DataFrame) -> DataFrame:
    by = (F.col("position").asc_nulls_last(), "doc_id")
    return out.repartitionByRange(n_tasks(out.sparkSession), *by).sortWithinPartitions(*by)


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """Copies and training positions of each row of ``docs`` (columns doc_id, source, text).

    Returns ``doc_id, source, size, source_size, target, copies, taken, position, positions``, range-sorted by
    ``position`` (rows that the mix leaves out last, with null). Within its source the documents lie in a
    fixed random order (md5 of the id and the text's md5); their words and then, once more, the same words fill the demand up
    to the target. A document is taken whole, once for each time its middle lies within the demand, so a
    source's words differ from the target by at most half a document. ``positions`` has one for each copy: the time at which
    the source's integrated schedule has asked for the words before that copy. ``position`` is the first of them.

    The running word count needs no sort of a whole source: each source is cut into ranges of the random
    order, as many as its rows ask for, ranges are added up first, and a window runs inside each range.
    Null text has size 0. Null source is a source, the last. A null id counts as an empty text. Repeated
    rows are documents of their own. An empty table gives an empty one. Extra columns are ignored.
    """
    return _sorted(_placed(docs.select("doc_id", "source", "text"), **options))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves in training order: a row for each copy that ``curriculum`` takes, range-sorted by that copy's ``position``.

    Columns are those of ``docs`` and ``size, source_size, target, copies, taken, position, copy`` (with an underscore behind where
    ``docs`` has such a column); ``copy`` counts from 0 and ``taken`` is the words of that copy. Documents that are left out have one
    row at the end, with no copy or position and nothing taken. Nulls, repeated rows and empty tables are as in ``curriculum``.
    """
    out = _placed(docs, whole=True, **options).drop("position").select("*", F.posexplode_outer("positions").alias("copy", "position"))
    out = out.withColumn("taken", F.when(F.col("copy").isNotNull(), F.col("size")).otherwise(0))
    added = [F.col(c).alias(fresh(docs, c)) for c in ("size", "source_size", "target", "copies", "taken", "position", "copy")]
    by = (F.col("position").asc_nulls_last(), "doc_id")
    out = out.repartitionByRange(n_tasks(out.sparkSession), *by).sortWithinPartitions(*by)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *added)
