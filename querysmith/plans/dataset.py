"""Cleaning of samples and assembly of multi-task chat datasets, with resumable stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialect, sql_text, text
from ..operators import dedup, stats
from ..sources import files
from . import execute, repair

Builder = Callable[[DataFrame], DataFrame]


def _records(df: DataFrame, task: str, messages: Column, error_type: Column | None = None) -> DataFrame:
    return df.select(messages.alias("messages"), F.lit(task).alias("task_type"), F.lit("ddl").alias("schema_type"), (error_type if error_type is not None else F.lit(None).cast("string")).alias("error_type"), "db_id")


def _prompt() -> Column:
    return text.user_prompt(F.col("schema_text"), F.col("question"), F.col("evidence"))


def text_to_sql(samples: DataFrame) -> DataFrame:
    return _records(samples, "text2sql", text.chat("text2sql", _prompt(), F.col("SQL")))


def schema_linking(samples: DataFrame) -> DataFrame:
    answer = F.concat_ws("\n", F.concat(F.lit("Tables: "), F.array_join(sql_text.tables(F.col("SQL")), ", ")), F.concat(F.lit("Columns: "), F.array_join(sql_text.column_refs(F.col("SQL")), ", ")))
    return _records(samples, "schema_linking", text.chat("schema_linking", _prompt(), answer))


def skeletons(samples: DataFrame) -> DataFrame:
    """Only queries whose skeleton differs from them."""
    made = sql_text.skeleton(F.col("SQL"))
    return _records(samples.filter(F.trim(made) != F.trim("SQL")), "skeleton_extraction", text.chat("skeleton_extraction", _prompt(), made))


def reasoning(samples: DataFrame) -> DataFrame:
    """Only complex queries; steps come from the query's parts."""
    return _records(samples.filter(sql_text.is_complex(F.col("SQL"))).withColumn("__c", sql_text.components(F.col("SQL"))), "chain_of_thought", text.chat("chain_of_thought", _prompt(), F.concat(steps_of(F.col("__c")), F.lit("\n\nSQL: "), F.col("SQL"))))


def steps_of(c: Column) -> Column:
    """Numbered steps of a query from its parts; wording and order are fixed values."""

    def step(name: str, head: str, shown: Column, between: str = ", ") -> Column:
        return F.when(F.size(c[name]) > 0, F.concat(F.lit(head), F.array_join(shown, between)))

    joins = F.transform(c["joins"], lambda j: F.concat(j["type"], F.lit(" `"), j["table"], F.lit("`"), F.when(j["on"] != "", F.concat(F.lit(" ON "), j["on"])).otherwise("")))
    steps = F.array(
        step("tables", "Identify the relevant tables: ", F.transform(c["tables"], lambda t: F.concat(F.lit("`"), t, F.lit("`")))),
        step("joins", "Join the tables: ", joins, "; "),
        step("conditions", "Apply filter conditions: WHERE ", c["conditions"], " AND "),
        step("aggregations", "Apply aggregation functions: ", c["aggregations"]),
        step("group_by", "Group the results: ", c["group_by"]),
        step("ordering", "Order the results: ", c["ordering"]),
        F.when(c["has_distinct"], F.lit("Apply DISTINCT to remove duplicates")),
        F.when(c["has_subquery"], F.lit("Use a subquery to compute an intermediate result")),
    )
    return text.numbered(F.filter(steps, lambda s: s.isNotNull()))


def corrections(samples: DataFrame, wrong: DataFrame, key: str = "idx") -> DataFrame:
    """One record for each sample with a verified mutation (key, error_type, wrong_sql)."""
    met = samples.join(wrong, key)
    user = F.concat(_prompt(), F.lit("\n\nIncorrect SQL: "), F.col("wrong_sql"))
    return _records(met, "sql_correction", text.chat("sql_correction", user, F.col("SQL")), F.col("error_type"))


BUILDERS: dict[str, Builder] = {"text2sql": text_to_sql, "schema_linking": schema_linking, "skeleton_extraction": skeletons, "chain_of_thought": reasoning}


def assemble(samples: DataFrame, builders: dict[str, Builder] = BUILDERS, wrong: DataFrame | None = None) -> DataFrame:
    """All tasks' records of all samples: a union of projections of one scan each."""
    parts = [f(samples) for f in builders.values()] + ([corrections(samples, wrong)] if wrong is not None else [])
    return reduce(DataFrame.unionByName, parts)


def build(samples: DataFrame, folder: str, seed: int = 42, ratio: float = 0.05, wrong: DataFrame | None = None) -> dict[str, DataFrame]:
    """Assemble, drop repeated records, shuffle by seed, split and write train, val and stats under folder."""
    generated = files.checkpoint(assemble(samples, wrong=wrong).withColumn("key", text.message_hash(F.col("messages"))).withColumn("idx", F.monotonically_increasing_id()), folder, "generated")
    unique = files.checkpoint(dedup.split(dedup.keep_first(generated, F.col("key"), "idx"), "key", seed, ratio), folder, "unique")
    out = {s: unique.filter(F.col("split") == s).drop("split", "idx") for s in ("train", "val")}
    for name, df in out.items():
        files.write_lines(df.orderBy(text.seeded_order(seed, F.col("key"))).drop("key"), f"{folder}/{name}")
    out["stats"] = stats.build_statistics(generated, unique, out["train"], out["val"])
    files.write_lines(out["stats"], f"{folder}/stats", single=True)
    return out


def clean(samples: DataFrame, folder: str, judge: DataFrame | repair.Ask | None = None, least: float = 0.7, schemas: dict[str, dialect.Schema] | None = None) -> DataFrame:
    """Samples whose query runs and returns rows and, given a judge or its replies (idx, reply), that it accepts. A
    judge is asked about samples that no run has asked about yet, with the first rows of their results.

    The stages loaded and executed are written under folder, and one that is there is not run again; a judge's
    stage is made anew. With schemas (by db_id), queries run as Spark's rewriting of the benchmark's dialect; the
    samples keep their own texts.
    """
    spark = samples.sparkSession
    loaded = files.resume(spark, folder, "loaded") or files.checkpoint(files.usable(samples), folder, "loaded")
    ran = files.resume(spark, folder, "executed")
    if ran is None:
        texts = loaded if schemas is None else dialect.rewritten(loaded, "SQL", schemas, "db_id")
        facts = execute.validated(spark, texts, "SQL", "idx").filter("status = 'ok' AND n_rows > 0")
        ran = files.checkpoint(loaded.join(facts.select("idx", "n_rows"), "idx"), folder, "executed")
    if judge is None:
        return ran
    if callable(judge):
        texts = ran if schemas is None else dialect.rewritten(ran, "SQL", schemas, "db_id")
        shown = execute.previews(spark, texts, "idx", "SQL", rows=repair.SHOWN).select("idx", "preview")
        known = ran if "schema_text" in ran.columns else ran.withColumn("schema_text", F.lit(None).cast("string"))
        told = repair.verdicts(known.join(shown, "idx"), judge, f"{folder}/verdicts")
        return files.checkpoint(told.filter(F.col("valid") & (F.col("confidence") >= least)).select(*ran.columns), folder, "semantic")
    seen = judge.select("idx", text.verdict(F.col("reply")).alias("v"))
    return files.checkpoint(ran.join(seen, "idx").filter(F.col("v.valid") & (F.col("v.confidence") >= least)).drop("v"), folder, "semantic")
