"""Judging and repair of queries in rounds: run, look at the result, ask a judge, rewrite, each answer kept in a store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.sql_parse import extract_sql
from ..functions.sql_text import repaired
from ..sources import files, store
from . import execute

#: Takes rows (key, prompt) and gives (key, reply).
Ask = Callable[[DataFrame], DataFrame]
#: Rows of a result that a judge sees, and the confidence from which its verdict counts.
SHOWN, LEAST = 10, 0.7
#: How a rewritten query starts; other replies change nothing.
QUERY = r"(?i)^\s*(SELECT|WITH)\b"


def _headed(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"### {head}:\n"), body) for head, body in parts))


def judge_prompt(db: Column, schema: Column, question: Column, sql: Column, preview: Column, total: Column) -> Column:
    """What a judge is asked: whether a query answers its question, given the schema and the first rows."""
    rows = F.when(total > SHOWN, F.concat(preview, F.lit("\n("), total.cast("string"), F.lit(" rows in all)"))).otherwise(preview)
    task = F.lit('Does the query answer the question, wholly and with the right tables, columns, joins, conditions and aggregates, and does its result look plausible? Reply with one JSON object and nothing else: {"valid": true or false, "confidence": 0 to 1, "reason": "one sentence"}')
    return _headed(("Database", db), ("Schema", schema), ("Question", question), ("Query", sql), ("First rows of its result", rows), ("Task", task))


def repair_prompt(schema: Column, question: Column, sql: Column, issue: Column) -> Column:
    """What a model is asked that rewrites a query."""
    return _headed(("Schema", schema), ("Question", question), ("Query", sql), ("What is wrong with it", issue), ("Task", F.lit("Write the right query, in a fence marked sql.")))


def verdicts(samples: DataFrame, judge: Ask, folder: str) -> DataFrame:
    """samples (question, SQL, db_id, schema_text, preview, n_rows and others) with the judge's verdict as columns valid,
    confidence, reason. An answer is kept under (question, SQL, db_id); only samples that have none are asked about."""
    keyed = samples.withColumn("key", text.cache_key(F.col("question"), F.col("SQL"), F.col("db_id")))
    prompt = judge_prompt(*(F.coalesce(c, F.lit("")) for c in ("db_id", "schema_text", "question", "SQL", "preview")), F.col("n_rows"))
    asked = keyed.select("key", prompt.alias("prompt"))
    replies = store.answered(asked, folder, "key", lambda df: df.join(judge(df.select("key", "prompt")).select("key", "reply"), "key")).select("key", "reply").distinct()
    seen = keyed.join(replies, "key", "left").withColumn("v", text.verdict(F.coalesce("reply", F.lit(""))))
    return seen.select(*samples.columns, F.col("v.valid").alias("valid"), F.col("v.confidence").alias("confidence"), F.col("v.reason").alias("reason"))


def repair(samples: DataFrame, folder: str, judge: Ask | None = None, fix: Ask | None = None, rounds: int = 3, seconds: float | None = execute.SHORT_LIMIT) -> DataFrame:
    """Samples (qid, question, db_id, schema_text, SQL) after up to `rounds` rounds: qid, SQL, status, rounds, issue.

    In a round the queries that are still open run once. One that fails is repaired by rules first, and by the
    model where those don't help; one that runs but whose result doesn't fit its question, or which the judge
    doesn't accept with confidence LEAST or more, goes to the model with that reason. A query without an issue is
    done, and so is one that nobody can change; its issue stays. Answers of judge and model are kept under
    folder by what was asked, so that a repeated run asks nothing twice. Samples stay frames: only query texts
    and their previews pass the driver, a page at a time.
    """
    spark = samples.sparkSession
    kind = samples.schema["qid"].dataType.simpleString()
    open_ = files.settled(samples.select("qid", "question", "db_id", F.coalesce("schema_text", F.lit("")).alias("schema_text"), F.trim("SQL").alias("SQL")))
    done: list[DataFrame] = []
    for turn in range(rounds + 1):
        facts = execute.previews(spark, open_, "qid", "SQL", rows=SHOWN, seconds=seconds)
        seen = files.settled(open_.join(facts.withColumnRenamed("total", "n_rows"), "qid"))
        failed, ran = seen.filter("status <> 'ok'"), seen.filter("status = 'ok'")
        doubt = text.suspicion(F.col("status"), F.col("n_rows"), F.col("question"))
        ran = ran.withColumn("issue", doubt)
        if judge is not None:
            judged = verdicts(ran.filter("issue IS NULL"), judge, f"{folder}/verdicts")
            against = F.when(~F.col("valid") & (F.col("confidence") >= LEAST), F.concat(F.lit("not what was asked: "), "reason"))
            ran = ran.filter("issue IS NOT NULL").unionByName(judged.withColumn("issue", against).drop("valid", "confidence", "reason"))
        wrong = failed.withColumn("issue", F.concat(F.lit("it fails: "), F.substring("error", 1, 500))).unionByName(ran)
        wrong = files.settled(wrong)
        good = wrong.filter("issue IS NULL")
        done.append(good.select("qid", "SQL", "status", F.lit(turn).alias("rounds"), F.lit(None).cast("string").alias("issue")))
        bad = wrong.filter("issue IS NOT NULL")
        if turn == rounds or bad.isEmpty():
            done.append(bad.select("qid", "SQL", "status", F.lit(turn).alias("rounds"), "issue"))
            break
        # Rules first, for queries that fail; what they make has to run.
        ruled = bad.filter("status <> 'ok'").withColumn("new", repaired(F.col("SQL"), F.col("error"))).filter("new <> SQL")
        works = execute.validated(spark, ruled, "new", "qid", seconds).filter("status = 'ok'").select("qid")
        ruled = ruled.join(works, "qid", "left_semi").select("qid", "new")
        rest = bad.join(ruled, "qid", "left_anti")
        if fix is not None:
            prompt = repair_prompt(F.col("schema_text"), F.col("question"), F.col("SQL"), F.col("issue"))
            asked = rest.withColumn("prompt", prompt).withColumn("key", text.cache_key(F.col("prompt")))
            replies = store.answered(asked.select("key", "prompt"), f"{folder}/rewrites", "key", lambda df: df.join(fix(df.select("key", "prompt")).select("key", "reply"), "key")).select("key", "reply").distinct()
            modelled = asked.join(replies, "key").withColumn("new", F.trim(extract_sql(F.col("reply")))).filter(F.col("new").rlike(QUERY) & (F.col("new") != F.col("SQL"))).select("qid", "new")
            ruled = ruled.unionByName(modelled)
        changed = files.settled(ruled)
        stuck = bad.join(changed, "qid", "left_anti")
        done.append(stuck.select("qid", "SQL", "status", F.lit(turn).alias("rounds"), "issue"))
        open_ = files.settled(open_.drop("SQL").join(changed.withColumnRenamed("new", "SQL"), "qid"))
        if open_.isEmpty():
            break
    empty = spark.createDataFrame([], f"qid {kind}, SQL string, status string, rounds int, issue string")
    return reduce(DataFrame.unionByName, done, empty)
