"""File sources and sinks. Paths are any that Spark can read, but for ``read_config``, which reads a file of the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRAIN_LOG


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON Lines file; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def infer_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_jsonl`` with an inferred schema, at the price of one more pass."""
    return spark.read.option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None, one_file: bool = True) -> None:
    """Overwrite ``path`` with JSON Lines, nulls kept, non-ASCII text as it is, in ``order`` if given.

    With ``one_file`` (for results of modest size) ``path`` is a file; without it a folder, whose files follow each
    other in order.
    """
    out = df.orderBy(order) if order else df
    target = f"{path}.parts" if one_file else path
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("ignoreNullFields", "false").json(target)
    if one_file:
        fs, folder = _file_system(df.sparkSession, target)
        jvm = df.sparkSession._jvm
        parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        to = jvm.org.apache.hadoop.fs.Path(path)
        fs.delete(to, True)
        if parts:
            fs.rename(parts[0], to)
        else:  # an empty table may leave no part
            fs.create(to, True).close()
        fs.delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and its path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_text(path: str, text: str) -> None:
    """Overwrite ``path`` (any that Spark can write) with ``text``; folders above it are made. Needs an active session."""
    fs, place = _file_system(SparkSession.active(), path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_object(df: DataFrame, path: str) -> None:
    """The single row of ``df`` as one indented JSON object."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a JSON object takes exactly one row")
    write_text(path, json.dumps(json.loads(rows[0][0]), indent=2, ensure_ascii=False))


def summary_path(path: str) -> str:
    """``log.jsonl`` to ``log.summary.json``."""
    return os.path.splitext(path)[0] + ".summary.json"


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """A trainer's history (a JSON array of rows of three kinds) with ``record_kind``: train, eval or final."""
    log = spark.read.schema(TRAIN_LOG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return with_record_kind(log)


def with_record_kind(log: DataFrame) -> DataFrame:
    kind = F.when(F.col("train_runtime").isNotNull(), "final").when(F.col("eval_loss").isNotNull(), "eval").otherwise("train")
    return log.withColumn("record_kind", kind)


def write_train_log(df: DataFrame, path: str) -> None:
    """All rows as one JSON array with null fields left out. A log has a row for each few training steps."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).toLocalIterator()]
    write_text(path, json.dumps(rows, indent=2))


def read_config(path: str, parse: Callable[[str], dict] | None = None) -> dict:
    """A nested configuration. JSON needs nothing; for YAML a parser is taken from the installed one, or given."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if parse:
        return parse(text)
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return parse_simple_yaml(text)
    return yaml.safe_load(text)


def parse_simple_yaml(text: str) -> dict:
    """Nested maps, scalars and lists of scalars by indentation: what training configurations use of YAML."""
    root: dict = {}
    open_at: list[tuple[int, dict | list]] = [(-1, root)]
    waiting: tuple[dict, str] | None = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if waiting and (indent > open_at[-1][0] or body.startswith("- ")):
            holder, key = waiting
            holder[key] = [] if body.startswith("- ") else {}
            open_at.append((indent - 1 if body.startswith("- ") else open_at[-1][0] + 1, holder[key]))
        waiting = None
        while len(open_at) > 1 and (indent <= open_at[-1][0] - 1 or indent < open_at[-1][0] or (isinstance(open_at[-1][1], list) and not body.startswith("- "))):
            open_at.pop()
        here = open_at[-1][1]
        if body.startswith("- "):
            here.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        if value.strip():
            here[key.strip()] = _scalar(value.strip())
        else:
            here[key.strip()] = None
            waiting = (here, key.strip())
            open_at[-1] = (indent, here)
    return root


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "~", "none"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
