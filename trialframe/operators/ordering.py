"""Dense numbering and order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def numbered(rows: DataFrame, *order: str, name: str = "number", partition: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``, 0 on without gaps in ``order``, for each ``partition`` if given.

    The first of ``order`` must be numeric. Its quantiles cut it into ``ranges``; ranges are counted, the counts
    summed up, and rows are numbered inside each range, so no task gets more than a range. ``rows`` is read three
    times: what may differ from run to run must be written before. Rows that agree in all of ``order`` are numbered
    in any order. Nulls come first. An empty table gives an empty one.
    """
    first, by = order[0], [partition] if partition else []
    cuts = rows.agg(F.percentile_approx(first, [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))  # one row
    cut = rows.join(F.broadcast(cuts)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(first))), F.lit(0))).drop("_cuts")
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    start = start.select(F.col("_range").alias("_r"), "_start", *[F.col(c).alias("_p") for c in by])
    same = F.col("_range") == F.col("_r")
    if by:
        same &= F.col(partition).eqNullSafe(F.col("_p"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    return cut.join(F.broadcast(start) if not by else start, same).withColumn(name, F.col("_start") + inside).drop("_range", "_r", "_start", "_p")


def reordered(rows: DataFrame, items: DataFrame, key: str = "id", place: str = "seq") -> DataFrame:
    """``rows`` with the ``place`` of their ``key`` in ``items``: the last place of a repeated key, 0 for a key that isn't there."""
    last = items.groupBy(F.col(key).alias("_k")).agg(F.max(place).alias("_place"))
    kept = [c for c in rows.columns if c != place]
    return rows.select(*kept).join(last, F.col(key) == F.col("_k"), "left").select(*kept, F.coalesce("_place", F.lit(0)).alias(place)).orderBy(place)
