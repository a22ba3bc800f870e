"""Records for training runs: filters of chat records, prompts for reinforcement, one text a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.sql_parse import extract_sql

#: Rows of prompts for reinforcement.
PROMPTS = ("system", "user", "db_id", "gold_sql")
#: Opening and closing of a turn in a text (fixed values of the chat format).
TURN = ("<|im_start|>", "<|im_end|>")


def chosen_records(records: DataFrame, tasks: list[str] | None = None, schemas: list[str] | None = None) -> DataFrame:
    """Records of two turns or more whose task and schema type are on the lists (names are stripped); a missing
    value is on no list, and no list lets all pass. The filter is a plain IN, so it reaches the scan."""
    out = records.filter(text.trainable(F.col("messages")))
    for name, allowed in (("task_type", tasks), ("schema_type", schemas)):
        if allowed:
            out = out.filter(F.col(name).isin(*(str(a).strip() for a in allowed)))
    return out


def prompts_of_chats(records: DataFrame) -> DataFrame:
    """PROMPTS of chat records: the last system and user message, the query in the last answer; rows without a
    user message or an answer are left out, a missing system message is that of the task text2sql."""
    m = F.col("messages")
    out = records.select(
        F.coalesce(text.last_of(m, "system"), F.lit(text.SYSTEM_MESSAGES["text2sql"])).alias("system"), text.last_of(m, "user").alias("user"),
        F.coalesce("db_id", F.lit("")).alias("db_id"), text.last_of(m, "assistant").alias("answer"),
    ).filter("user IS NOT NULL AND answer IS NOT NULL")
    return out.withColumn("gold_sql", extract_sql(F.col("answer"))).select(*PROMPTS)


def prompts_of_samples(samples: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """PROMPTS of raw samples (question, SQL, db_id, evidence); rows without question, query or database are left
    out. schemas: db_id, schema_text, by broadcast where its size allows; an unknown one is named as such."""
    whole = text.present(F.col("question")) & text.present(F.col("SQL")) & text.present(F.col("db_id"))
    rows = samples.filter(whole)
    rows = rows.join(schemas, "db_id", "left") if schemas is not None else rows.withColumn("schema_text", F.lit(None).cast("string"))
    shown = F.coalesce("schema_text", F.concat(F.lit("-- Schema for database: "), "db_id", F.lit(" (not available)")))
    user = text.user_prompt(shown, F.col("question"), F.coalesce("evidence", F.lit("")))
    return rows.select(F.lit(text.SYSTEM_MESSAGES["text2sql"]).alias("system"), user.alias("user"), "db_id", F.col("SQL").alias("gold_sql"))


def prompts(chats: DataFrame | None, samples: DataFrame | None, schemas: DataFrame | None = None) -> DataFrame:
    """Both formats as one table of PROMPTS."""
    parts = ([prompts_of_chats(chats)] if chats is not None else []) + ([prompts_of_samples(samples, schemas)] if samples is not None else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def templated(messages: Column) -> Column:
    """All turns as one text; null for no turns."""
    turn = lambda m: F.concat(F.lit(TURN[0]), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(TURN[1] + "\n"))
    return F.when(F.size(messages) > 0, F.array_join(F.transform(messages, turn), ""))


def texts(records: DataFrame, template=templated) -> DataFrame:
    """text of each record; blank ones are left out."""
    return records.select(template(F.col("messages")).alias("text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
