"""Tokens: a pluggable tokenizer for workers, a built-in one by code points, and the cut between prompt and answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a worker turns into tokens at once.
PORTION = 256


class Tokenizer(Protocol):
    """Built once for each task, so it may load a vocabulary."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def code_points(text: Column) -> Column:
    """A token for each character, its code point. Null stays null; empty text has no token."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii))


def from_code_points(ids: Column) -> Column:
    """Text of code points below 2^16 in the encoding of ``code_points``."""
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i.cast("long")), 4, "0")), "")), "UTF-16BE")


def tokenize(rows: DataFrame, make: Callable[[], Tokenizer], text: str = "text", ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids``, the tokens of ``text`` (null for null)."""
    return _mapped(rows, make, text, ids, "array<int>", _encoded)


def detokenize(rows: DataFrame, make: Callable[[], Tokenizer], ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with ``text``, the decoded ``ids`` (null for null)."""
    return _mapped(rows, make, ids, text, "string", _decoded)


def _encoded(tool: Tokenizer, texts: pa.Array) -> pa.Array:
    return pa.array([np.array(tool.encode(x.as_py()), np.int32) if x.is_valid else None for x in texts], pa.list_(pa.int32()))


def _decoded(tool: Tokenizer, ids: pa.Array) -> pa.Array:
    return pa.array([tool.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in ids], pa.string())


def _mapped(rows: DataFrame, make, source: str, target: str, kind: str, some) -> DataFrame:
    """Only the row at hand has Python's numbers. Spark's default batch of 10,000 rows is lowered (a value the user has set is kept), and whatever it is, workers do it in portions."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = make()
        for part in parts:
            for i in range(0, len(part), PORTION):
                yield some(tool, part.slice(i, PORTION))

    return rows.withColumn(target, run(F.col(source)))


def strip_prompt(output: Column, prompt_size: Column) -> Column:
    """What a model has added: its ``output`` tokens after the ``prompt_size`` (padding included) that it was given."""
    return F.slice(output, prompt_size + 1, F.greatest(F.size(output) - prompt_size, F.lit(0)))


def before_token(ids: Column, stop: int) -> Column:
    """``ids`` up to the first ``stop``, all where there is none."""
    at = F.array_position(ids, stop)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)
