"""Statistics of samples and chat records: stages, retention, lengths, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


def stage_statistics(samples: DataFrame, question: str, sql: str, db: str) -> DataFrame:
    """One row: samples, databases, lengths of questions and queries in characters, from one aggregation."""
    q = F.length(question)
    return samples.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(db).alias("databases"),
        F.round(F.avg(q), 4).alias("avg_question"), F.min(q).alias("min_question"), F.max(q).alias("max_question"),
        F.round(F.avg(F.length(sql)), 4).alias("avg_sql"),
    )


def stage_details(samples: DataFrame, db: str = "db_id", k: int = 5) -> DataFrame:
    """One row: the k most frequent databases as text, rows that are valid, and the mean confidence, where the columns are there."""
    counts = samples.groupBy(F.coalesce(F.col(db), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
    shown = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value", "n"))), lambda x: F.concat(x["value"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ").alias("top"))
    has = lambda c: c in samples.columns
    valid = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) if has(c) else F.lit(None).cast("long").alias(c) for c in ("exec_valid", "semantic_valid")]
    sure = F.round(F.avg("semantic_confidence"), 3) if has("semantic_confidence") else F.lit(None).cast("double")
    return samples.agg(*valid, sure.alias("confidence")).crossJoin(shown)  # one row each


def retention(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each stage and their share of the first stage's, in percent."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages.items())]
    table = reduce(DataFrame.unionByName, counts)
    first = table.filter("step = 0").select(F.col("n").alias("loaded"))
    return table.crossJoin(F.broadcast(first)).select("step", "stage", "n", F.round(100.0 * F.col("n") / F.greatest("loaded", F.lit(1)), 4).alias("percent"))  # one row each


def word_lengths(turns: DataFrame, key: str, role: str, text: str) -> DataFrame:
    """Words per conversation of each role and in total: min, max, mean, upper median.

    The upper median comes from counts of lengths, so no list of a segment's values is built.
    """
    words = turns.select(F.col(key).alias("k"), F.col(role).alias("segment"), word_count(F.col(text)).alias("w"))
    per = words.select("k", "w", F.explode(F.array("segment", F.lit("total"))).alias("segment")).groupBy("k", "segment")
    sums = per.agg(F.sum("w").alias("n"))
    counts = sums.groupBy("segment", "n").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("segment").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy("segment")))
    return ranked.groupBy("segment").agg(
        F.sum("c").alias("n"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 1).alias("mean"),
        F.min(F.when(F.col("upto") > F.expr("all div 2"), F.col("n"))).alias("median"),
    )


def distribution(df: DataFrame, value: Column, order: Column, k: int | None = None) -> DataFrame:
    """Counts of values with their share in percent, most frequent first (ties: first seen), the first k."""
    counts = df.groupBy(F.coalesce(value, F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    total = counts.agg(F.sum("n").alias("all"))
    shared = counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent"), "seen")  # one row on the right
    ordered = shared.orderBy(F.desc("n"), "seen")
    return (ordered if k is None else ordered.limit(k)).drop("seen")


def build_statistics(generated: DataFrame, unique: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """Counts of a dataset build: metric, key, n."""

    def by(df: DataFrame, metric: str, column: str) -> DataFrame:
        return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "key", "n")

    def all_of(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")

    parts = [by(generated, "generated", "task_type"), all_of(generated, "before_dedup"), all_of(unique, "after_dedup"), all_of(train, "train"), all_of(val, "val"), by(unique, "final", "task_type"), by(unique, "databases", "db_id")]
    return reduce(DataFrame.unionByName, parts)


def analysis(train: DataFrame, val: DataFrame, most: int = 50) -> DataFrame:
    """metric, key, n of a dataset's analysis: sizes, tasks, the most frequent databases, schema types, difficulties."""
    both = train.unionByName(val, allowMissingColumns=True)
    sizes = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("metric"), F.lit("").alias("key"), "n") for m, df in (("total_samples", both), ("train_samples", train), ("val_samples", val))]

    def counts(metric: str, column: str, k: int | None = None) -> list[DataFrame]:
        if column not in both.columns:
            return []
        found = both.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return [(found if k is None else found.orderBy(F.desc("n"), "key").limit(k)).select(F.lit(metric).alias("metric"), "key", "n")]

    parts = sizes + counts("task_distribution", "task_type") + counts("db_distribution", "db_id", most) + counts("format_distribution", "schema_type") + counts("difficulty_distribution", "difficulty")
    return reduce(DataFrame.unionByName, parts)


#: Samples an hour by memory in GB and size of model, and the size of dataset that is assumed (fixed values).
RATES = {"7B": {24: 800, 40: 1200, 48: 1500, 80: 2500}, "14B": {24: 300, 40: 600, 48: 800, 80: 1500}}
ASSUMED = 20_000


def rate(memory: Column, model: str = "14B") -> Column:
    """Samples an hour of the nearest bracket of memory (ties: the smaller one)."""
    near = F.array_min(F.array(*(F.struct(F.abs(F.lit(m) - memory).alias("d"), F.lit(m).alias("m"), F.lit(r).alias("r")) for m, r in RATES[model].items())))
    return near["r"]


def hours(memory: Column, model: str = "14B", epochs: int = 3) -> Column:
    """Estimated hours as text: minutes below an hour, days from 24 hours on."""
    h = F.lit(float(ASSUMED * epochs)) / rate(memory, model)
    return (
        F.when(memory <= 0, "Cannot estimate without GPU")
        .when(h < 1, F.concat(F.lit("~"), F.floor(h * 60).cast("string"), F.lit(" minutes")))
        .when(h < 24, F.format_string("~%.1f hours", h))
        .otherwise(F.format_string("~%.1f days", h / 24))
    )
