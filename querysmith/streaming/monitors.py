"""Monitors of training runs over streams: running and trailing means of each key, with a bounded history as state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import importable

#: Decimals of values that are added up.
SCALE = 6


def group_diversity(responses: Column) -> Column:
    """Distinct responses (stripped, lower-cased) as a share of all, of an array; null without any."""
    plain = F.transform(responses, lambda r: F.lower(F.trim(r)))
    return F.when(F.size(responses) > 0, F.size(F.array_distinct(plain)) / F.size(responses))


def steps(keys: tuple, order: list, values: list, state: tuple[int, int, list[int]], width: int) -> tuple[list[tuple], tuple[int, int, list[int]]]:
    """Rows (key, order, running mean, trailing mean) of values in their order, and the state behind them: how many
    values there were, their sum, and the last width - 1 rows (nulls included). Sums are whole numbers of 10^-6."""
    n, total, last = state
    out = []
    for at, value in zip(order, values, strict=True):
        whole = None if value is None or not math.isfinite(value) else int((Decimal(repr(value)) * 10**SCALE).to_integral_value("ROUND_HALF_UP"))
        if whole is not None:
            n, total = n + 1, total + whole
        last = [*last, whole][-width:]
        seen = [x for x in last if x is not None]
        out.append((*keys, at, total / n / 10**SCALE if n else None, sum(seen) / len(seen) / 10**SCALE if seen else None))
    return out, (n, total, last[-(width - 1) :] if width > 1 else [])


def means(stream: DataFrame, key: str, order: str, value: str, width: int = 100) -> DataFrame:
    """key, order, running_mean (of all values of the key so far) and trailing_mean (of the last `width` rows) for each
    row of a stream whose rows of a key arrive in order; within a micro-batch they may come in any order.

    The state of a key is two numbers and width - 1 values, whatever its history; a micro-batch holds the rows of one
    key at once. Values count to six decimals; null and non-finite ones count for neither mean. Batch frames have
    reward.running_mean and reward.trailing_mean.
    """
    importable(stream.sparkSession)
    kind = dict(stream.dtypes)
    schema = f"{key} {kind[key]}, {order} {kind[order]}, running_mean double, trailing_mean double"
    rows = stream.select(key, order, F.col(value).cast("double").alias("x"))
    names = [key, order, "running_mean", "trailing_mean"]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: tuple[int, int, list[int]]) -> tuple[pd.DataFrame, tuple]:
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out, state = steps(keys, frame[order].tolist(), [None if pd.isna(x) else float(x) for x in frame["x"]], state, width)
        return pd.DataFrame(out, columns=names), state

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (0, "0", [])
        out, (n, total, last) = run(keys, frames, (before[0], int(before[1]), list(before[2])))
        state.update((n, str(total), last))
        yield out

    return rows.groupBy(key).applyInPandasWithState(update, schema, "n long, total string, last array<long>", "append", GroupStateTimeout.NoTimeout)
