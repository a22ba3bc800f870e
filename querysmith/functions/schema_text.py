"""Schema texts for prompts, from catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted_sample(value: Column, type_: Column) -> Column:
    """Text in single quotes (in double ones if it has a single quote inside), backslashes and line ends escaped; other values plain."""
    safe = value
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        safe = F.replace(safe, F.lit(raw), F.lit(shown))
    single, double = value.contains("'"), value.contains('"')
    plain = F.concat(F.lit("'"), F.when(single & double, F.replace(safe, F.lit("'"), F.lit("\\'"))).otherwise(safe), F.lit("'"))
    text = F.when(single & ~double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(plain)
    return F.when(type_ == "VARCHAR", text).otherwise(value)


def example_lists(samples: DataFrame, columns: DataFrame, n: int = 3) -> DataFrame:
    """table, column, examples: the first n samples of each column as one text."""
    met = samples.join(F.broadcast(columns.select("table", "column", "type")), ["table", "column"])
    lists = met.groupBy("table", "column").agg(F.slice(F.array_sort(F.collect_list(F.struct("value", quoted_sample(F.col("value"), F.col("type")).alias("shown")))), 1, n).alias("s"))
    return lists.select("table", "column", F.array_join(F.transform("s", lambda x: x["shown"]), ", ").alias("examples"))


def light(columns: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """A Markdown table for each table; columns: table, cid, column, type, key, and description where known."""
    rows = _with(columns, examples)
    note = F.when(F.col("examples") == "", F.col("description")).otherwise(
        F.when(F.col("description") == "", F.concat(F.lit("e.g. "), "examples")).otherwise(F.concat("description", F.lit(" (e.g. "), "examples", F.lit(")")))
    )
    line = F.concat(F.lit("| "), "column", F.lit(" | "), "type", F.lit(" | "), "key", F.lit(" | "), note, F.lit(" |"))
    head = F.concat(F.lit("### Table: "), "table", F.lit("\n| Column | Type | Key | Description |\n|--------|------|-----|-------------|\n"))
    return _joined(rows, line, "\n").select("table", F.concat(head, "body").alias("schema_text"))


def ddl(columns: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """A CREATE TABLE statement for each table, with notes on columns."""
    rows = _with(columns, examples)
    notes = F.concat_ws("; ", F.when(F.col("description") != "", F.col("description")), F.when(F.col("examples") != "", F.concat(F.lit("e.g. "), "examples")))
    line = F.concat(
        F.lit('  "'), "column", F.lit('" '), "type",
        F.when(F.col("pk"), " PRIMARY KEY").otherwise(""), F.when(F.col("notnull"), " NOT NULL").otherwise(""),
        F.coalesce(F.concat(F.lit(" DEFAULT "), "default"), F.lit("")),
        F.when(notes != "", F.concat(F.lit("  -- "), notes)).otherwise(""),
    )
    text = F.concat(F.lit('CREATE TABLE "'), "table", F.lit('" (\n'), "body", F.lit("\n);"))
    return _joined(rows, line, ",\n").select("table", text.alias("schema_text"))


def link_comments(links: DataFrame) -> DataFrame:
    """All foreign keys as one comment block, by table."""
    line = F.concat(F.lit("-- "), "from_table", F.lit("."), "from_column", F.lit(" -> "), "to_table", F.lit("."), "to_column")
    return links.agg(F.concat(F.lit("\n-- Foreign Keys:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from_table", "place", line.alias("line")))), lambda x: x["line"]), "\n")).alias("schema_text"))


def whole(tables: DataFrame) -> DataFrame:
    """All tables' texts as one, by name, a blank line between."""
    return tables.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "schema_text"))), lambda x: x["schema_text"]), "\n\n").alias("schema_text"))


def _with(columns: DataFrame, examples: DataFrame | None) -> DataFrame:
    rows = columns if examples is None else columns.join(examples, ["table", "column"], "left")
    for name in ("examples", "description"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit(""))
    return rows


def _joined(rows: DataFrame, line: Column, between: str) -> DataFrame:
    """Lines of a table by cid (a table's columns are few)."""
    lists = rows.select("table", F.struct("cid", line.alias("line")).alias("x")).groupBy("table").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("table", F.array_join(F.transform("x", lambda x: x["line"]), between).alias("body"))
