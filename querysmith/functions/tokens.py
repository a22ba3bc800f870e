"""Token ids of texts by a tokenizer file, over Arrow batches, and labels of chats for training."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..session import importable
from . import text

#: Characters and texts that are encoded together: what an encoding takes is a hundred times its text.
SLICE, TEXTS = 1 << 19, 256

_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def ids_of(texts: list[str], path: str) -> list[list[int]]:
    return [e.ids for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, as many at a time as fit in SLICE and TEXTS; a longer text comes alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and (size + len(t) > SLICE or len(part) == TEXTS):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def token_ids(value: Column, path: str, most: int | None = None) -> Column:
    """Ids of each text, the first `most` of them; null has none.

    A worker loads the file once. It holds the encodings of a slice, whatever the rows and lengths of a batch.
    """
    importable()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
            for part in slices(t or "" for t in batch):
                yield pd.Series([np.array(x[:most], dtype=np.int32) for x in ids_of(part, path)], dtype=object)

    return ids(value)


def labelled(chats: DataFrame, messages: str, path: str, templated, role: str = "assistant", most: int = 2048, turn: tuple[str, str] = ("<|im_start|>", "<|im_end|>")) -> DataFrame:
    """chats with ids (cut to `most`) and labels: ids of the role's turns with their end, -100 elsewhere.

    A turn starts behind the ids of the header, wherever these occur, and ends with the first id of the end mark,
    as they are found in the ids themselves, so truncated chats and any tokenizer file go the same way.
    """
    header, end = ids_of([f"{turn[0]}{role}\n"], path)[0], ids_of([turn[1]], path)[0][0]
    rows = chats.withColumn("ids", token_ids(templated(F.col(messages)), path, most))
    labels = text.bound(F.col("ids"), lambda ids: text.masked_labels(ids, text.turn_spans(ids, header, end)))
    return rows.withColumn("labels", labels)


def batched(rows: DataFrame, key: str, size: int = 8, pad: int = 0, ignore: int = -100) -> DataFrame:
    """Rows with ids and labels in batches of `size` in the order of a unique key, each padded to its batch's own
    longest row: batch, and ids, labels and mask (1 for ids, 0 for padding)."""
    placed = ranks.numbered(rows, key, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    mask = text.padded(F.transform("ids", lambda _: F.lit(1)), F.col("__longest"), 0)
    wide = placed.withColumn("__longest", longest).withColumn("mask", mask)
    return wide.withColumn("labels", text.padded(F.col("labels"), F.col("__longest"), ignore)).withColumn("ids", text.padded(F.col("ids"), F.col("__longest"), pad)).drop("__longest")
