"""Exact cosine search over embedding columns, and the prompt lines made of its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import nearest


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for zero vectors."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(entries: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """The k nearest entries (id, v) of each query (qid, q): qid, id, distance, rank; ties: the smaller id; an entry
    isn't its own hit. With same, only entries that agree in that column are looked at. See nearest.search."""
    return nearest.search(entries, queries, k, same)


def top_k_or_any(entries: DataFrame, queries: DataFrame, k: int, same: str) -> DataFrame:
    """top_k within the column's value; queries for which there is no entry get hits from everywhere."""
    within = files.settled(nearest.search(entries, queries, k, same))
    rest = queries.join(within.select("qid").distinct(), "qid", "left_anti").drop(same)
    if rest.isEmpty():
        return within
    return within.unionByName(nearest.search(entries.drop(same), rest, k))


def value_hints(hits: DataFrame) -> DataFrame:
    """Lines of potentially relevant values for each query: qid, hints; hits: qid, table, column, value, rank."""
    once = hits.groupBy("qid", "table", "column", "value").agg(F.min("rank").alias("rank"))
    line = F.concat(F.lit("- "), "table", F.lit("."), "column", F.lit(": '"), "value", F.lit("'"))
    lists = once.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return lists.select("qid", F.concat(F.lit("-- Potentially relevant values:\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("hints"))
