"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every linked node.

    ``links`` has columns ``a`` and ``b`` (long; order, repeats and self-links don't matter; nulls are
    dropped). Returns ``node, root`` for the nodes of ``links``. Alternating large-star and small-star
    steps: each round hangs larger neighbours on the smallest one, so the rounds grow with the logarithm
    of the node count, and no step holds a node's neighbours in memory: only minima are aggregated.
    Each round is written to the shared folder. An empty table gives an empty table.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    last = None
    for _ in range(max_rounds):
        # Large star: every neighbour larger than u gets u's smallest neighbour (or u itself).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: of the neighbours not above u, all get the smallest.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), F.col("u"), F.col("m"))
        step = (
            small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = written(step)
        # A sum of hashes: the link set is the same when count and sum are.
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        forget(edges)
        edges = new
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
