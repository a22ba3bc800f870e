"""Accuracy roll-ups, taxonomy of errors, comparison of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql_text

#: Difficulties that a report always shows, and kinds of errors in the order in which they are tried.
DIFFICULTIES = ("simple", "moderate", "challenging")
ERRORS = ("syntax_error", "timeout", "empty_result", "wrong_columns", "wrong_filter", "wrong_join", "wrong_aggregation", "other")


def positional(left: DataFrame, right: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows of the same place in both; the longer one's rest is left out."""
    return left.join(right, idx)


def accuracy(facts: DataFrame, difficulties: tuple[str, ...] = DIFFICULTIES) -> DataFrame:
    """Correct, total and accuracy overall, by difficulty and by database, in one pass of grouping sets.

    facts: correct, difficulty, db_id. Every difficulty of the list has a row; others count overall only.
    """
    sets = facts.groupingSets([[], ["difficulty"], ["db_id"]], "difficulty", "db_id").agg(
        F.sum(F.col("correct").cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping("difficulty").alias("gd"), F.grouping("db_id").alias("gb")
    )
    level = F.when(F.col("gd") == 0, "difficulty").when(F.col("gb") == 0, "database").otherwise("overall")
    named = sets.select(level.alias("level"), F.coalesce("difficulty", "db_id", F.lit("")).alias("key"), "correct", "total").filter((F.col("level") != "difficulty") | F.col("key").isin(*difficulties))
    spark: SparkSession = facts.sparkSession
    wanted = spark.createDataFrame([("difficulty", d) for d in difficulties] + [("overall", "")], "level string, key string")
    full = named.join(F.broadcast(wanted), ["level", "key"], "full").fillna(0, ["correct", "total"])
    return full.withColumn("accuracy", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 4))


def scalar_accuracy(facts: DataFrame) -> DataFrame:
    """Share of correct rows; failures (null) are wrong, no rows give 0."""
    return facts.agg(F.coalesce(F.round(F.avg(F.coalesce("correct", F.lit(False)).cast("double")), 4), F.lit(0.0)).alias("accuracy"))


def accuracy_or_exact(facts: DataFrame) -> DataFrame:
    """Execution accuracy over rows with a known database; if there are none, exact match of normalised SQL."""
    one = facts.agg(F.count_if("valid_db").alias("n"), F.avg(F.when(F.col("valid_db"), F.col("correct").cast("double"))).alias("executed"), F.avg(F.col("exact").cast("double")).alias("exact"))
    return one.select(F.when(F.col("n") > 0, F.col("executed")).otherwise(F.coalesce("exact", F.lit(0.0))).alias("accuracy"))


def error_kind(status: Column, rows: Column, pred: Column, gold: Column) -> Column:
    """The first kind of ERRORS that fits a wrong prediction."""
    return (
        F.when(status == "timeout", "timeout")
        .when(status != "ok", "syntax_error")
        .when(rows == 0, "empty_result")
        .when(sql_text.differs_in_columns(pred, gold), "wrong_columns")
        .when(sql_text.differs_in_filter(pred, gold), "wrong_filter")
        .when(sql_text.differs_in_joins(pred, gold), "wrong_join")
        .when(sql_text.differs_in_aggregates(pred, gold), "wrong_aggregation")
        .otherwise("other")
    )


def error_taxonomy(facts: DataFrame, examples: int = 3) -> DataFrame:
    """Count and first examples (least idx) of each kind; kinds without errors have zero.

    facts: idx, correct, status, n_rows, pred_sql, gold_sql.
    """
    wrong = facts.filter(~F.col("correct")).withColumn("kind", error_kind(F.col("status"), F.col("n_rows"), F.col("pred_sql"), F.col("gold_sql")))
    counts = wrong.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(_window("kind", "idx"))
    first = wrong.select("kind", "idx").withColumn("r", rank).filter(F.col("r") <= examples).groupBy("kind").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    names = facts.sparkSession.createDataFrame([(k,) for k in ERRORS], "kind string")
    full = names.join(counts, "kind", "left").join(first, "kind", "left")
    return full.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("examples"))


def _window(by: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)


def compare_methods(facts: DataFrame, difficulties: tuple[str, ...] = DIFFICULTIES) -> DataFrame:
    """A row for each method: overall accuracy and one column a difficulty (0 where it has no rows)."""
    rate = lambda cond: F.coalesce(F.round(F.avg(F.when(cond, F.col("correct").cast("double"))), 4), F.lit(0.0))
    return facts.groupBy("method").agg(rate(F.lit(True)).alias("overall"), *(rate(F.col("difficulty") == d).alias(d) for d in difficulties))


def disagreements(facts: DataFrame, a: str, b: str) -> DataFrame:
    """Places where two methods differ: idx, correct_a, correct_b."""
    left = facts.filter(F.col("method") == a).select("idx", F.col("correct").alias("correct_a"))
    right = facts.filter(F.col("method") == b).select("idx", F.col("correct").alias("correct_b"))
    return left.join(right, "idx").filter("correct_a != correct_b")


def per_sample(facts: DataFrame, previews: DataFrame | None = None) -> DataFrame:
    """What is kept of each judged sample: idx, db_id, difficulty, question, gold_sql, pred_sql, correct, previews, error.

    facts: those columns but the previews; previews: sql, preview.
    """
    out = facts
    for side in ("pred", "gold"):
        shown = F.lit(None).cast("string")
        if previews is not None:
            out = out.join(previews.select(F.col("sql").alias(f"{side}_sql"), F.col("preview").alias(f"{side}_result_preview")), f"{side}_sql", "left")
        else:
            out = out.withColumn(f"{side}_result_preview", shown)
    return out.select("idx", "db_id", F.lower(F.coalesce("difficulty", F.lit("unknown"))).alias("difficulty"), "question", "gold_sql", "pred_sql", "correct", "pred_result_preview", "gold_result_preview", "error")


def results(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """The evaluation as one JSON object (overall, by_difficulty, by_database, error_analysis), without samples."""
    entry = F.struct("correct", "total", "accuracy")
    levels = rows.groupBy(F.lit(1).alias("one")).agg(
        F.first(F.when(F.col("level") == "overall", entry), True).alias("overall"),
        *(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("key", entry.alias("x")))))).alias(f"by_{level}") for level in ("difficulty", "database")),
    )
    kinds = errors.groupBy(F.lit(1).alias("one")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.struct(F.col("n").alias("count")).alias("x"))))).alias("error_analysis"))
    return levels.join(kinds, "one").select(F.to_json(F.struct("overall", "by_difficulty", "by_database", "error_analysis")).alias("value"))


def report(rows: list, errors: list, samples: list = (), worst: int = 10) -> str:
    """A Markdown report of collected roll-ups (accuracy and error_taxonomy, both small) and the first wrong samples."""
    overall = next(r for r in rows if r["level"] == "overall")
    lines = ["# Evaluation report", "", f"Total samples: {overall['total']}", f"Execution accuracy: {overall['accuracy']:.4f} ({overall['correct']} correct)", "", "| Difficulty | Correct | Total | Accuracy |", "|---|---|---|---|"]
    lines += [f"| {r['key']} | {r['correct']} | {r['total']} | {r['accuracy']:.4f} |" for r in rows if r["level"] == "difficulty"]
    low = sorted((r for r in rows if r["level"] == "database"), key=lambda r: (r["accuracy"], r["key"]))[:worst]
    lines += ["", "## Lowest databases", "", "| Database | Correct | Total | Accuracy |", "|---|---|---|---|", *(f"| {r['key']} | {r['correct']} | {r['total']} | {r['accuracy']:.4f} |" for r in low)]
    lines += ["", "## Errors", "", *(f"- {e['kind']}: {e['n']}" for e in errors)]
    if samples:
        lines += ["", "## First wrong samples"]
        for s in list(samples)[:worst]:
            lines += ["", f"### {s['db_id']} ({s['difficulty']})", f"- Question: {s['question']}", f"- Gold: `{s['gold_sql']}`", f"- Predicted: `{s['pred_sql']}`", *([f"- Error: {s['error']}"] if s["error"] else [])]
    return "\n".join(lines) + "\n"


def first_wrong(samples: DataFrame, n: int = 10) -> DataFrame:
    """The first wrong samples by idx."""
    return samples.filter(~F.coalesce("correct", F.lit(False))).orderBy("idx").limit(n)
