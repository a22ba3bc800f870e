"""Calls of models (embedders, generators, judges) over columns of texts: loaded once a worker, tried again, never fatal."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable

#: A model takes texts and gives as many values.
Model = Callable[[list[str]], list]
#: Tries of a call, texts of a call, and seconds before the second try (doubled before each further one).
TRIES, TOGETHER, WAIT = 3, 32, 0.1

_models: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The worker's own copy of a model, made by its first call."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def attempt(model: Model, texts: list[str], tries: int, wait: float) -> tuple[list | None, str]:
    """Values of a call, or None and the last error."""
    error = ""
    for n in range(tries):
        if n:
            time.sleep(wait * 2 ** (n - 1))
        try:
            values = list(model(texts))
            if len(values) == len(texts):
                return values, ""
            error = f"{len(values)} values for {len(texts)} texts"
        except Exception as e:  # whatever a model raises belongs to its rows
            error = f"{type(e).__name__}: {e}"[:500]
    return None, error


def called(model: Model, texts: list[str | None], tries: int = TRIES, wait: float = WAIT) -> list[tuple[object, str | None]]:
    """(value, error) of each text. Texts that fail together are called one by one, so that one bad text doesn't
    take the others with it; null texts have neither value nor call."""
    at = [i for i, t in enumerate(texts) if t is not None]
    out: list[tuple[object, str | None]] = [(None, "no text")] * len(texts)
    values = attempt(model, [texts[i] for i in at], 1, wait)[0] if len(at) > 1 else None
    for n, i in enumerate(at):
        one, error = (values[n : n + 1], "") if values is not None else attempt(model, [texts[i]], tries, wait)
        out[i] = (one[0], None) if one is not None else (None, error)
    return out


def call(value: Column, name: str, load: Callable[[], Model], kind: str = "string", tries: int = TRIES, together: int = TOGETHER, wait: float = WAIT) -> Column:
    """Struct (value of the given type, error) of a model's answer to each text; error is null where it answered.

    load runs once in each worker (by name); it and the model travel by pickling, so what is large belongs into load.
    """
    importable()

    @F.pandas_udf(f"value {kind}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(name, load)
        for batch in batches:
            texts, rows = [None if pd.isna(t) else t for t in batch], []
            for i in range(0, len(texts), together):
                rows += called(model, texts[i : i + together], tries, wait)
            yield pd.DataFrame({"value": pd.Series([v for v, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

    return run(value)


def generator(name: str, load: Callable[[], Model], tries: int = TRIES) -> Callable[[DataFrame], DataFrame]:
    """A generator for predictions: questions (qid, prompt) to qid, reply, error."""
    return lambda rows: rows.select("qid", call(F.col("prompt"), name, load, tries=tries).alias("r")).select("qid", F.col("r.value").alias("reply"), F.col("r.error").alias("error"))


def embedder(name: str, load: Callable[[], Model], tries: int = TRIES) -> Callable[[Column], Column]:
    """An embedding of a column of texts; null where the model fails."""
    return lambda value: call(value, name, load, "array<double>", tries)["value"]
