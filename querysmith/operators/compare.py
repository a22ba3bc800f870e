"""Equality of result sets as multisets with tolerance, and keys by which results are grouped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, NumericType, StringType

from . import ranks

TOLERANCE = 1e-4
#: Result keys of failed and of empty results (fixed values).
ERROR_KEY, EMPTY_KEY = "__ERROR__", "__EMPTY__"


def normalised(value: Column, kind: DataType) -> Column:
    """Fractions to four digits, text trimmed and lower-cased, others as they are."""
    if isinstance(kind, DoubleType | FloatType | DecimalType):
        return F.round(value.cast("double"), 4)
    if isinstance(kind, StringType):
        return F.lower(F.trim(value))
    return value


def _frame(df: DataFrame) -> DataFrame:
    out = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return out.select(*(normalised(F.col(f.name), f.dataType).alias(f.name) for f in out.schema.fields))


def same_results(pred: DataFrame | None, gold: DataFrame | None, tolerance: float = TOLERANCE, sizes: tuple[int, int] | None = None, unequal: bool = False) -> bool:
    """Whether two results are equal whatever the order of their rows and the names of their columns.

    None stands for a failed query: equal to None only. Rows are compared as multisets first. If that fails,
    columns in which both sides are fractions are compared with the tolerance and all others as text, so that
    1 equals '1': rows that agree in the latter are ranked by the former, in ranges of the first of them, and
    compared place by place. Nulls sort first and equal nulls. Only counts and booleans reach the driver;
    sizes are the numbers of rows where they are known, and unequal says that the multisets are known to differ
    (by their keys). Results that fit in one bucket are ranked in one partition each, without shuffles.
    """
    if pred is None or gold is None:
        return pred is None and gold is None
    p, g = _frame(pred), _frame(gold)
    n, m = sizes or (p.count(), g.count())
    if n != m:
        return False
    if not n:
        return True
    if len(p.columns) != len(g.columns):
        return False
    if not unequal and [f.dataType for f in p.schema] == [f.dataType for f in g.schema] and _balanced(p, g):
        return True
    close = [c for c in p.columns if isinstance(p.schema[c].dataType, NumericType) and isinstance(g.schema[c].dataType, NumericType)]
    exact = [c for c in p.columns if c not in close]
    shared = lambda df: df.select(*(F.col(c).cast("double").alias(c) if c in close else F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in df.columns))
    p, g = shared(p), shared(g)
    if not close:
        return _balanced(p, g)

    def placed(df: DataFrame, prefix: str) -> DataFrame:
        order = [F.col(c).asc_nulls_first() for c in close]
        rows = df if exact else df.withColumn("__all", F.lit(0))
        if n <= ranks.BUCKET_ROWS:
            place = F.row_number().over(Window.partitionBy(*(exact or ["__all"])).orderBy(*order))
            return rows.coalesce(1).select(*(F.col(c).alias(prefix + c) for c in df.columns), place.alias(prefix + "__place"))
        out = ranks.ranked(ranks.in_ranges(rows, close[0]), exact or ["__all"], F.col("__b"), order, "__place", "__of")
        return out.select(*(F.col(c).alias(prefix + c) for c in [*df.columns, "__place"]))

    left, right = placed(p, ""), placed(g, "g_")
    near = [F.coalesce(F.abs(F.col(c) - F.col(f"g_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"g_{c}").isNull()) for c in close]
    met = left.join(right, ranks.same_keys([*exact, "__place"], "g_")).filter(reduce(lambda a, b: a & b, near))
    return met.count() == n


def _balanced(p: DataFrame, g: DataFrame) -> bool:
    """Whether both sides have each row as often."""
    signed = p.withColumn("__n", F.lit(1)).unionByName(g.withColumn("__n", F.lit(-1)))
    return signed.groupBy(*p.columns).agg(F.sum("__n").alias("n")).filter("n != 0").isEmpty()


def multiset_differs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows of normalised results that one side has more often: all columns, surplus (negative: gold has more)."""
    p, g = _frame(pred), _frame(gold)
    signed = p.withColumn("__n", F.lit(1)).unionByName(g.withColumn("__n", F.lit(-1)))
    return signed.groupBy(*p.columns).agg(F.sum("__n").alias("surplus")).filter("surplus != 0")


def row_text(df: DataFrame) -> DataFrame:
    """One text a row of normalised cells; equal for equal rows."""
    n = _frame(df)
    return n.select(F.to_json(F.struct(*n.columns), {"ignoreNullFields": "false"}).alias("row"))


def result_key(df: DataFrame | None) -> str:
    """A key that equal results share whatever the order of rows; failed and empty ones have keys of their own.

    Distinct rows are counted, and their digests are added up as numbers, so no list of rows is built.
    """
    if df is None:
        return ERROR_KEY
    digest = F.sha2(F.col("row"), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    got = row_text(df).agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return EMPTY_KEY if not got["n"] else "-".join(str(x) for x in got)
