"""Model inference as a batch function: the library has the adapter, not the model."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sampling:
    """How a model picks its next token. A temperature of ``GREEDY_TO`` or less is greedy, and ``top_p`` then has no say."""

    temperature: float = 0.0
    top_p: float = 1.0
    max_new_tokens: int = 512

    GREEDY_TO = 1e-4

    @property
    def greedy(self) -> bool:
        return self.temperature <= self.GREEDY_TO

    def settings(self) -> dict:
        """Generation arguments in the usual names."""
        chosen = {} if self.greedy else {"temperature": self.temperature, "top_p": self.top_p}
        return {"max_new_tokens": self.max_new_tokens, "do_sample": not self.greedy, **chosen}


#: Of a checkpoint's evaluation and of pair building.
EVALUATION, PAIRS = Sampling(), Sampling(0.8, 0.95, 400)


def is_greedy(temperature: Column) -> Column:
    return temperature <= F.lit(Sampling.GREEDY_TO)


class Completer(Protocol):
    """Completes a batch of rendered prompts. Built once for each task, so it may load a model."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def load_completer(name: str, *args, **options) -> Callable[[], Completer]:
    """A maker of completers from ``module:callable``: called in each task with ``args`` and ``options``, such as a
    checkpoint's folder and a ``Sampling``. This is how models are loaded; the library has none."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError("a completer is named module:callable")

    def make() -> Completer:
        return getattr(importlib.import_module(module), attribute)(*args, **options)

    return make


class LookupCompleter:
    """Answers from a table; for tests and for replaying logs."""

    def __init__(self, answers: dict[str, str], default: str = ""):
        self.answers, self.default = answers, default

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, self.default) for p in prompts]


class FixedCompleter:
    """One answer to every prompt; for trying out a command line."""

    def __init__(self, answer: str = "", sampling: Sampling | None = None):
        self.answer = answer

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer] * len(prompts)


def complete(rows: DataFrame, make: Callable[[], Completer], prompt: str = "rendered", batch_size: int = 16) -> DataFrame:
    """``rows`` with ``completion`` and ``gen_time_sec`` (a batch's time over its rows). Limits belong before this step."""
    import time

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = make()
        for part in parts:
            for i in range(0, len(part), batch_size):
                batch = part.iloc[i : i + batch_size].copy()
                began = time.monotonic()
                batch["completion"] = completer(batch[prompt].tolist())
                batch["gen_time_sec"] = (time.monotonic() - began) / len(batch)
                yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, schema + ", completion string, gen_time_sec double")
