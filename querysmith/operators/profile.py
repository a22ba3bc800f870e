"""Column profiles: counts, exact distinct counts, ranges, samples and frequent values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType

PROFILE = ("table", "column", "row_count", "null_count", "distinct_count", "min", "max")


def shown(value: Column, kind: DataType) -> Column:
    """One explicit text form for each type, so profiles of all columns fit in one table."""
    if isinstance(kind, DoubleType | FloatType):
        return F.format_string("%.4f", value)
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, DateType):
        return F.date_format(value, "yyyy-MM-dd")
    return value.cast("string")


def widened(kind: DataType) -> DataType:
    """The type in which a column's values are told apart and ordered; columns of one such type share a field."""
    if isinstance(kind, ByteType | ShortType | IntegerType):
        return LongType()
    return DoubleType() if isinstance(kind, FloatType) else kind


def profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of each table: row, null and distinct counts, least and greatest value as text.

    Each table is scanned once. A row gives one entry for each column, with its value in the field of its type;
    entries are counted by (column, value) in each task before they move, and one shuffle brings all columns'
    values together, so what moves is distinct values. NaN is a value and the greatest one.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = [(t, f.name, f.dataType) for t, df in tables.items() for f in df.schema.fields]
    kinds = {widened(k).simpleString(): widened(k) for *_, k in columns}
    names = {k: f"v{i}" for i, k in enumerate(kinds)}
    parts, at = [], 0
    for df in tables.values():
        entries = []
        for f in df.schema.fields:
            own = widened(f.dataType).simpleString()
            values = [(F.col(f"`{f.name}`").cast(kind) if k == own else F.lit(None).cast(kind)).alias(names[k]) for k, kind in kinds.items()]
            entries.append(F.struct(F.lit(at).alias("at"), *values))
            at += 1
        parts.append(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    groups = reduce(DataFrame.unionByName, parts).groupBy("at", *names.values()).agg(F.count(F.lit(1)).alias("n"))
    value = reduce(lambda a, b: a | b, (F.col(v).isNotNull() for v in names.values()))
    ends = [f(F.col(v)).alias(f"{n}_{v}") for v in names.values() for n, f in (("min", F.min), ("max", F.max))]
    found = groups.groupBy("at").agg(F.sum("n").alias("row_count"), F.sum(F.when(~value, F.col("n")).otherwise(0)).alias("null_count"), F.count_if(value).alias("distinct_count"), *ends)
    text = lambda end: F.coalesce(*(F.when(F.col(f"{end}_{v}").isNotNull(), shown(F.col(f"{end}_{v}"), kinds[k])) for k, v in names.items())).alias(end)
    asked = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(columns)], "at int, table string, column string")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return asked.join(found, "at", "left").select("table", "column", *map(count, ("row_count", "null_count", "distinct_count")), text("min"), text("max"))


def profile(table: str, df: DataFrame) -> DataFrame:
    """profiles() of one table."""
    return profiles({table: df})


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table"), "row_count") for t, df in tables.items()))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values (ties: the smaller value), ranked; counts are summed before the ranking."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.select(F.lit(column).alias("column"), "value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("rank"))


def samples(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n smallest distinct values that aren't null."""
    kind = df.schema[column].dataType
    found = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct().orderBy("v").limit(n)
    return found.select(F.lit(column).alias("column"), shown(F.col("v"), kind).alias("value"))


def text_values(tables: dict[str, DataFrame], most: int | None = 500, longest: int | None = 500) -> DataFrame:
    """Distinct trimmed values of all text columns, the `most` smallest of each (None: all, of any length): table, column, value."""
    parts = []
    for t, df in tables.items():
        for f in df.schema.fields:
            if f.dataType.simpleString() == "string":
                trimmed = df.select(F.trim(F.col(f.name)).alias("value")).filter(F.length("value") >= 1)
                if longest is not None:
                    trimmed = trimmed.filter(F.length("value") <= longest)
                trimmed = trimmed.distinct()
                if most is not None:
                    trimmed = trimmed.orderBy("value").limit(most)
                parts.append(trimmed.select(F.lit(t).alias("table"), F.lit(f.name).alias("column"), "value"))
    return reduce(DataFrame.unionByName, parts)


def nested(profile_rows: DataFrame) -> DataFrame:
    """Profiles as one row a table with a map of columns, for export."""
    entry = F.struct(*(F.col(c) for c in profile_rows.columns if c not in ("table", "column", "row_count")))
    return profile_rows.groupBy("table").agg(F.first("row_count").alias("row_count"), F.map_from_entries(F.collect_list(F.struct("column", entry.alias("profile")))).alias("columns"))


def described(profile_rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Profiles with their descriptions; those that have none get an empty one."""
    return profile_rows.join(F.broadcast(descriptions), ["table", "column"], "left").fillna("", ["description"])


def batches(df: DataFrame, order: Iterable[str], size: int, out: str = "batch") -> DataFrame:
    """Numbered batches of at most size rows in an order; for small tables such as columns of a database."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))
