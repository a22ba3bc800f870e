"""Functions over questions, model replies and chat messages; built-in expressions but for the scanner of questions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import importable
from . import canonical

#: System messages of the five tasks (fixed values, as trained models expect them).
SYSTEM_MESSAGES = {
    "text2sql": "You are an expert SQL assistant. Given a database schema and a natural language question, generate the correct SQL query.",
    "schema_linking": "You are a database expert. Given a database schema and a natural language question, identify which tables and columns are needed to answer the question.",
    "sql_correction": "You are an expert SQL debugger. Given a database schema, a natural language question, and an incorrect SQL query, identify the error and provide the corrected SQL query.",
    "chain_of_thought": "You are an expert SQL assistant. Given a database schema and a natural language question, think through the problem step by step and generate the correct SQL query.",
    "skeleton_extraction": "You are an expert SQL assistant. Given a database schema and a natural language question, generate a SQL query skeleton with value placeholders.",
}
#: Words by which a question asks for counts or lists, and for one specific thing (fixed values).
COUNT_OR_LIST = ("how many", "count", "number of", "list", "all")
COUNT_WORDS = ("how many", "count", "number of", "total")
LIST_WORDS = ("list", "all", "show", "find")
SPECIFIC = ("which", "what is the", "who", "find the", "the highest", "the lowest", "maximum", "minimum")
#: Above this many rows, the answer to a specific question is suspicious.
MANY_ROWS = 10_000


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words, anywhere."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def present(text: Column) -> Column:
    """Not null and not empty."""
    return text.isNotNull() & (text != "")


def word_count(text: Column) -> Column:
    """Words between white space; an empty or null text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


#: What a quoted string starts and ends with.
QUOTES = ("'", '"')


def _quote(text: str, start: int) -> int:
    """Where the next quote is; -1 for none."""
    found = [at for at in (text.find(q, start) for q in QUOTES) if at >= 0]
    return min(found, default=-1)


def _without_strings(text: str) -> str:
    """A quote that has another one behind it, with something between them, opens a string; either kind closes either."""
    out, at, start = [], 0, _quote(text, 0)
    while start >= 0 and (close := _quote(text, start + 1)) >= 0:
        if close == start + 1:
            start = close
            continue
        out += [text[at:start], "<STRING>"]
        at = close + 1
        start = _quote(text, at)
    return "".join([*out, text[at:]])


#: Runs of letters, digits and underscores, and what is between them.
RUN = re.compile(r"\w+|\W+")


def skeleton_of(text: str) -> str:
    """Quoted strings, then dates (three numbers with hyphens or slashes between them, of four digits for the year, which
    comes first or last, and of one or two for the others), then numbers, with a fraction or not."""
    runs = RUN.findall(_without_strings(text))
    size = {i: len(run) for i, run in enumerate(runs) if run.isdecimal()}
    for wanted in (((4,), (1, 2), (1, 2)), ((1, 2), (1, 2), (4,))):
        for i in list(size):
            if all(size.get(i + 2 * n) in widths for n, widths in enumerate(wanted)) and runs[i + 1] in ("-", "/") and runs[i + 3] in ("-", "/"):
                runs[i : i + 5] = ["<DATE>", "", "", "", ""]
                for n in (0, 2, 4):
                    del size[i + n]
    for i in list(size):
        if i in size:
            runs[i] = "<NUMBER>"
            if i + 2 in size and runs[i + 1] == ".":
                runs[i + 1] = runs[i + 2] = ""
                del size[i + 2]
    return "".join(runs)


def question_skeleton(text: Column) -> Column:
    """skeleton_of a column of questions, over Arrow batches: strings, dates and numbers as <STRING>, <DATE>, <NUMBER>."""
    importable()

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else skeleton_of(x))

    return scan(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalised_sql(sql: Column) -> Column:
    """Trimmed, without semicolons at the end, lower-cased."""
    return F.lower(F.regexp_replace(trimmed(sql), r";+$", ""))


def unfenced(text: Column) -> Column:
    """A reply without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(trimmed(text), r"^```[a-z]*\s*", ""), r"\s*```$", "")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def verdict(reply: Column) -> Column:
    """Struct (valid, confidence in 0..1, reason) of a judge's JSON reply; what can't be parsed is not valid."""
    parsed = F.from_json(unfenced(reply), "valid boolean, confidence double, reason string")
    good = parsed["valid"].isNotNull()
    return F.struct(
        F.coalesce(parsed["valid"], F.lit(False)).alias("valid"),
        F.when(good, clamp(F.coalesce(parsed["confidence"], F.lit(0.0)))).otherwise(0.0).alias("confidence"),
        F.when(good, F.coalesce(parsed["reason"], F.lit(""))).otherwise("parse error").alias("reason"),
    )


def user_prompt(schema: Column, question: Column, evidence: Column) -> Column:
    """Schema, question, evidence where there is any, and the instruction."""
    hint = F.when(F.trim(evidence) != "", F.concat(F.lit("Evidence: "), evidence))
    return F.concat_ws("\n\n", F.concat(F.lit("Database Schema:\n"), schema), F.concat(F.lit("Question: "), question), hint, F.lit("Generate the SQL query."))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(task: str, user: Column, answer: Column) -> Column:
    """The three messages of a training record."""
    return F.array(message("system", F.lit(SYSTEM_MESSAGES[task])), message("user", user), message("assistant", answer))


def last_of(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null if there is none."""
    found = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(found, F.lit(-1))["content"]


def trainable(messages: Column) -> Column:
    """At least two turns; null is not."""
    return F.coalesce(F.size(messages) >= 2, F.lit(False))


#: Messages of a chat.
MESSAGES = ArrayType(StructType([StructField("role", StringType()), StructField("content", StringType())]))


def message_hash(messages: Column) -> Column:
    """SHA-256 of the messages' canonical JSON, characters beyond ASCII as they are."""
    return F.sha2(canonical.written(messages, MESSAGES, ascii_only=False), 256)


def numbered(steps: Column) -> Column:
    """Non-empty steps as numbered lines, or a single line where there are none."""
    kept = F.filter(steps, lambda s: F.trim(s) != "")
    lines = F.transform(kept, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.when(F.size(kept) > 0, F.concat_ws("\n", lines)).otherwise("1. Construct the SQL query to answer the question")


#: Lines of prompts with examples (fixed values).
NO_REASONING = "To answer this question, we need to query the relevant tables and apply the appropriate conditions."
INSTRUCTION = "Generate the SQL query."
DIVIDE = "Break this question into sub-questions, solve each one, and combine them into the final SQL query."


def examples_prompt(examples: Column, style: str = "direct") -> Column:
    """Numbered examples (question, sql, reasoning), a blank line between; style: direct, cot or divide."""

    def one(e: Column, i: Column) -> Column:
        head = F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\nQuestion: "), e["question"])
        reasoning = F.when(F.coalesce(e["reasoning"], F.lit("")) != "", e["reasoning"]).otherwise(NO_REASONING)
        why = F.concat(F.lit("Reasoning: "), reasoning) if style == "cot" else F.lit(None)
        return F.concat_ws("\n", head, why, F.concat(F.lit("SQL: "), e["sql"]))

    return F.concat_ws("\n\n", F.transform(examples, one))


def example_question(schema: Column, question: Column, evidence: Column, examples: Column, style: str = "direct") -> Column:
    """The user message of a prompt with examples: headed parts, empty ones left out."""
    shown = F.when(F.size(examples) > 0, F.concat(F.lit("### Examples:\n"), examples_prompt(examples, style)))
    hint = F.when(F.trim(evidence) != "", F.concat(F.lit("### Evidence:\n"), evidence))
    return F.concat_ws("\n\n", F.concat(F.lit("### Database Schema:\n"), schema), shown, F.concat(F.lit("### Question:\n"), question), hint, F.lit(DIVIDE if style == "divide" else INSTRUCTION))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of a canonical JSON array of the parts (null: empty text), by which answers are cached."""
    texts = F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.sha2(canonical.written(texts, ArrayType(StringType())), 256)


def descriptions(reply: Column) -> Column:
    """Array of (column, description) of a JSON array reply; null where it can't be parsed."""
    return F.from_json(F.regexp_extract(unfenced(reply), r"(?s)(\[.*\])", 1), "array<struct<column:string,description:string>>")


def quoted_name(name: Column) -> Column:
    """A name in back-ticks, those inside doubled."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def task_of(system: Column) -> Column:
    """The task that a system message stands for, by its first matching key word."""
    low = F.lower(F.coalesce(system, F.lit("")))
    any_of = lambda *words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return (
        F.when(any_of("schema linking", "identify the relevant"), "schema_linking")
        .when(any_of("correct", "fix", "error"), "sql_correction")
        .when(any_of("skeleton", "template"), "skeleton_extraction")
        .when(any_of("step-by-step", "chain of thought"), "chain_of_thought")
        .otherwise("text2sql")
    )


def suspicion(status: Column, rows: Column, question: Column) -> Column:
    """Why a result looks wrong for its question; null if it doesn't."""
    return (
        F.when(status != "ok", "no result")
        .when((rows == 0) & has_any(question, COUNT_WORDS), "empty result for a count")
        .when((rows == 0) & has_any(question, LIST_WORDS), "empty result for a list")
        .when((rows > MANY_ROWS) & has_any(question, SPECIFIC), "too many rows for a specific question")
    )


def result_score(status: Column, rows: Column, sql: Column, question: Column) -> Column:
    """Heuristic score of a candidate's result: higher is better, 0 if it failed."""
    points = (
        F.lit(10.0)
        + F.when(rows > 0, 5.0).when(has_any(question, COUNT_OR_LIST), -2.0).otherwise(0.0)
        + F.when(rows.between(1, 1000), 3.0).otherwise(0.0)
        + F.when((rows > MANY_ROWS) & has_any(question, SPECIFIC), -2.0).otherwise(0.0)
        + F.when(F.upper(trimmed(sql)).startswith("SELECT"), 2.0).otherwise(0.0)
    )
    return F.when(status == "ok", points).otherwise(0.0)


def duration(seconds: Column) -> Column:
    """Seconds as 12.3s, 4m 5s or 1h 2m."""
    whole = F.floor(seconds)
    minutes, hours = F.floor(whole / 60), F.floor(whole / 3600)
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.concat(minutes.cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def collection_name(db_id: Column, prefix: str = "cells_", longest: int = 63) -> Column:
    """A store's collection name: safe characters, letters or digits at both ends, cut with a hash if too long."""
    safe = F.regexp_replace(F.concat(F.lit(prefix), db_id), r"[^A-Za-z0-9_-]", "_")
    cut = F.concat(F.substring(safe, 1, longest - 8), F.substring(F.md5(db_id), 1, 8))
    name = F.when(F.length(safe) > longest, cut).otherwise(safe)
    return F.regexp_replace(F.regexp_replace(name, r"^[^A-Za-z0-9]+", ""), r"[^A-Za-z0-9]+$", "")


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once a row, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def turn_spans(ids: Column, header: list[int], end: int) -> Column:
    """Spans (start, end) of turns in token ids: from behind each occurrence of the header's ids to behind the next
    end id, or to the last id where none follows."""
    h, wanted = len(header), F.array(*map(F.lit, header))

    def spans(x: Column) -> Column:
        n = F.size(x)
        found = F.filter(F.sequence(F.lit(0), F.greatest(n - h, F.lit(0))), lambda i: (F.get(x, i) == header[0]) & (F.slice(x, i + 1, F.lit(h)) == wanted))

        def span(i: Column) -> Column:
            close = F.array_position(F.slice(x, i + h + 1, F.greatest(n - h - i, F.lit(0))), F.lit(end)).cast("int")
            return F.struct((i + h).alias("start"), F.when(close > 0, i + h + close).otherwise(n).alias("end"))

        return F.when(n >= h, F.transform(found, span)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return bound(ids, spans)


def masked_labels(ids: Column, spans: Column, ignore: int = -100) -> Column:
    """ids where a span (start, end) of the assistant covers them, else ignore."""
    covered = lambda s, i: F.exists(s, lambda x: (x["start"] <= i) & (i < x["end"]))
    return bound(spans, lambda s: F.transform(ids, lambda x, i: F.when(covered(s, i), x).otherwise(ignore)))


def padded(ids: Column, length: Column, fill: int) -> Column:
    """ids filled up to the length."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(ids)).cast("int")))


def chosen(options: list[str], seed: Column) -> Column:
    """One of the options by a hash of the seed: random in effect, the same each time."""
    pick = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long") % len(options)
    return F.element_at(F.array(*map(F.lit, options)), (pick + 1).cast("int"))


def seeded_order(seed: int, key: Column) -> Column:
    """A shuffle key that depends on nothing but seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
