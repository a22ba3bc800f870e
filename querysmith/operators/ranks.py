"""Exact ranks and running sums without gathering a group in one task: buckets, and prefix sums over buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

#: Rows that one bucket aims to hold, and the most buckets that are made.
BUCKET_ROWS, MAX_BUCKETS = 1024, 1 << 20


def bucket_count(rows: int) -> int:
    """A power of two that follows the rows, so that a bucket stays small."""
    n = 1
    while n * BUCKET_ROWS < rows and n < MAX_BUCKETS:
        n *= 2
    return n


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns with their prefixed namesakes."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def ranked(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], rank: str, total: str) -> DataFrame:
    """Exact 1-based rank (and group size) of each row of a group, without gathering a group.

    bucket has to be monotone in order within a group. Rows are ranked within (group, bucket), and the
    counts of earlier buckets of the group are added. df is read twice, so it has to give the same rows twice.
    """
    df = df.withColumn("__b", bucket)
    keys = [*groups, "__b"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b")
    ahead = counts.select(
        *(F.col(k).alias(f"__k_{k}") for k in keys),
        (F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__ahead"),
        F.sum("__n").over(Window.partitionBy(*groups)).alias(total),
    )
    local = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = local.join(ahead, same_keys(keys, "__k_"), "inner").withColumn(rank, F.col("__r") + F.col("__ahead"))
    return out.drop("__b", "__r", "__ahead", *(f"__k_{k}" for k in keys))


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """df with the number of the range that each row lies in (__b, monotone in the order, nulls first).

    Spark samples the order and cuts it into as many ranges as a shuffle has partitions, each with about as many
    rows whatever the values are: outliers, infinities and text are ranged as well as even numbers. Equal values
    share a range. The rows are written once, so that all readers see the same cuts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.settled(df.repartitionByRange(parts, F.col(order).asc_nulls_first()).withColumn("__b", F.spark_partition_id().cast("long")))


def numbered(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """df with 1-based places in the order of a key, which has to be unique."""
    marked = in_ranges(df.withColumn("__all", F.lit(0)), key)
    return ranked(marked, ["__all"], F.col("__b"), [F.col(key)], out, "__total").drop("__all", "__total").withColumn(out, F.col(out).cast("long"))
