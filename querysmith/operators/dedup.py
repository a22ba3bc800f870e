"""Keeping first occurrences, seeded orders, splits and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded_order


def keep_first(df: DataFrame, content: Column, order: str) -> DataFrame:
    """The row of the least order of each content (compared by SHA-256; null contents count as one).

    Only hashes and orders are grouped, with partial sums, so a content with many copies is no hot key;
    rows are then picked by order, which has to be unique.
    """
    hashes = df.select(F.col(order).alias("__o"), F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256).alias("__h"))
    first = hashes.groupBy("__h").agg(F.min("__o").alias("__o")).select("__o")
    return df.join(first, F.col(order) == F.col("__o"), "left_semi")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in an order that only seed and key decide."""
    return df.orderBy(seeded_order(seed, F.col(key)), key)


def capped(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by the seeded order (top-k in each task, then merged)."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def split(df: DataFrame, key: str, seed: int, ratio: float | None = 0.05, size: int | None = None) -> DataFrame:
    """df with split: val for exactly max(1, floor(n * ratio)) rows, or size rows if there are more; else train.

    The border is the order key of the last validation row. It is found by halving over counts of hash
    prefixes, so no global sort or single-task window is needed. Keys have to be unique; a null key comes last.
    """
    marked = df.withColumn("__s", seeded_order(seed, F.col(key)))
    n = marked.count()
    want = size if size is not None else max(1, int(n * ratio))
    if size is not None and n <= size:
        return df.withColumn("split", F.lit("train"))
    digits, prefix, left = 4, "", want
    while True:
        inside = marked.filter(F.col("__s").startswith(prefix))
        counts = sorted((r["p"], r["n"]) for r in inside.groupBy(F.substring("__s", 1, len(prefix) + digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        for p, c in counts:
            if c > left:
                break
            left -= c
        else:
            return marked.withColumn("split", F.when(F.col("__s").isNotNull() | F.lit(left > 0), "val").otherwise("train")).drop("__s")
        if left == 0 or c <= 4096 or len(p) >= 28:
            break
        prefix = p
    rest = [r for r in marked.filter(F.col("__s").startswith(p)).select("__s", key).orderBy("__s", key).limit(left).collect()] if left else []
    val = F.col("__s") < F.lit(p)
    if rest:
        last, kind = rest[-1], df.schema[key].dataType
        val = val | (F.col("__s") < last[0]) | ((F.col("__s") == last[0]) & (F.col(key) <= F.lit(last[1]).cast(kind)))
    return marked.withColumn("split", F.when(val, "val").otherwise("train")).drop("__s")
