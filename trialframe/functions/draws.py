"""Random draws that depend on their arguments alone: not on partitions, order or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *parts: Column | int | str) -> Column:
    """32 bits of the md5 of ``seed|part|part...`` as a long; SQL engines with md5 give the same number."""
    cols = [F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def draw(n: Column | int, seed: int, *parts: Column | int | str) -> Column:
    """A number from 0 to ``n - 1``."""
    return digest(seed, *parts) % (n if isinstance(n, Column) else F.lit(n))


def pick(choices: list, seed: int, *parts: Column | int | str) -> Column:
    """One of ``choices``."""
    return F.element_at(F.array(*map(F.lit, choices)), (draw(len(choices), seed, *parts) + 1).cast("int"))
