"""Rewards of generated queries and statistics of groups of rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import sql_text
from ..functions.text import normalised_sql
from . import ranks

#: Reward of a query that runs but is wrong, of naming the gold tables, and what keeps a spread from zero.
PARTIAL, TABLES, EPSILON = 0.1, 0.05, 1e-8


def reward(status: Column, match: Column, has_db: Column, pred: Column, gold: Column) -> Column:
    """1 for the gold result, 0.1 for any other result, 0 for none; 0.05 more if the tables named are the same.

    Without a database: 1 or 0 by equality of the normalised text.
    """
    base = F.when(status != "ok", 0.0).when(match, 1.0).otherwise(PARTIAL)
    named = F.when(sql_text.same_tables(pred, gold), TABLES).otherwise(0.0)
    return F.when(has_db, base + named).otherwise((normalised_sql(pred) == normalised_sql(gold)).cast("double"))


def advantages(rollouts: DataFrame, group: str, value: str) -> DataFrame:
    """rollouts with (value - mean) / (sample deviation + 1e-8) within the group; a group of one has 0.

    Means come from an aggregation with partial sums and are joined back, so a large group isn't sorted.
    """
    means = rollouts.groupBy(F.col(group).alias("__g")).agg(F.avg(value).alias("__m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("__s"))
    met = rollouts.join(means, F.col(group).eqNullSafe(F.col("__g")))
    return met.withColumn("advantage", (F.col(value) - F.col("__m")) / (F.col("__s") + EPSILON)).drop("__g", "__m", "__s")


def group_metrics(rollouts: DataFrame, group: str, value: str) -> DataFrame:
    return rollouts.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("deviation"))


def informative(rollouts: DataFrame, group: str, value: str) -> DataFrame:
    """Rollouts of groups whose rewards differ."""
    spread = rollouts.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo < hi").select(group)
    return rollouts.join(spread, group, "left_semi")


def diversity(responses: DataFrame, group: str, text: str, least: float = 0.3) -> DataFrame:
    """Share of distinct responses (trimmed, lower-cased) in each group, and whether it has collapsed."""
    share = F.count_distinct(F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))) / F.count(F.lit(1))
    return responses.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("diversity")).withColumn("collapsed", F.col("diversity") < least)


def mean_diversity(groups: DataFrame) -> DataFrame:
    """Mean over groups; 1 without any."""
    return groups.agg(F.coalesce(F.round(F.avg("diversity"), 6), F.lit(1.0)).alias("mean_diversity"))


def exact_mean(value: Column, over: WindowSpec | None = None, scale: int = 6) -> Column:
    """Mean of the values to `scale` decimals, summed as decimals, so that neither order nor partitions show. Values count
    to `scale` decimals and have to be below 10^(28 - scale) in size; larger ones are an overflow error."""
    total, n = F.sum(value.cast(f"decimal(28,{scale})")), F.count(value)
    return (total.over(over) / n.over(over)) if over is not None else total / n


def trailing_mean(steps: DataFrame, order: str, value: str, width: int = 100, by: str | None = None, block: int = 10_000) -> DataFrame:
    """steps with the mean of the last width values in a unique order (of each key of by), as a decimal.

    Rows get exact ranks and are averaged in blocks of ranks; a block also gets the last width - 1 rows of
    the one before it, so a key with most of the rows is as many tasks as it has blocks.
    """
    key = by or "__all"
    rows = steps if by else steps.withColumn("__all", F.lit(0))
    placed = ranks.ranked(ranks.in_ranges(rows, order), [key], F.col("__b"), [F.col(order)], "__rank", "__total")
    block = max(block, width)
    home = F.expr(f"(__rank - 1) div {block}")
    edge = (F.col("__rank") - 1) % block >= block - width + 1
    both = placed.withColumn("__block", F.explode(F.when(edge, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(key, "__block").orderBy("__rank").rowsBetween(1 - width, 0)
    out = both.withColumn("trailing_mean", exact_mean(F.col(value), w)).filter(F.col("__block") == home)
    return out.drop("__rank", "__total", "__block", "__all")


def running_mean(steps: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """steps with the mean of all values so far in a unique order of each key, as a decimal.

    Running sums within ranges of the order, plus the sums of the ranges before.
    """
    x = F.col(value).cast("decimal(28,6)")
    rows = ranks.in_ranges(steps, order)
    parts = rows.groupBy(by, "__b").agg(F.sum(x).alias("__s"), F.count(value).alias("__n"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col(by).alias(f"__k_{by}"), F.col("__b").alias("__k___b"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    w = Window.partitionBy(by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__ls", F.coalesce(F.sum(x).over(w), F.lit(0))).withColumn("__ln", F.count(value).over(w))
    met = local.join(ahead, ranks.same_keys([by, "__b"], "__k_"))
    total, n = (F.col("__ls") + F.col("__s")).cast("decimal(28,6)"), F.col("__ln") + F.col("__n")
    return met.withColumn("running_mean", F.when(n > 0, total / n)).drop("__b", "__ls", "__ln", "__s", "__n", f"__k_{by}", "__k___b")


def last_steps(steps: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """The last rows in an order: what a bounded log keeps (top-k in each task, then merged)."""
    return steps.orderBy(F.desc(order)).limit(most)


def timings(batches: DataFrame, seconds: str) -> DataFrame:
    """Number, total and mean of times; no rows give zeros."""
    return batches.agg(F.count(seconds).alias("n"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 3).alias("total"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)) / F.greatest(F.count(seconds), F.lit(1)), 3).alias("mean"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins between low and high; values outside fall into the first and last."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
