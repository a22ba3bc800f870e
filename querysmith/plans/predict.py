"""Prediction of queries for questions: schema, examples, generation, refinement, selection, with times of each."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import vote
from ..operators.compare import ERROR_KEY
from ..sources import files
from . import execute, repair

#: What is answered where nothing was generated (fixed value), and the names of the stages that are timed.
NOTHING, STAGES = "SELECT 1;", ("schema", "icl_retrieval", "generation", "refinement", "selection")
Generator = Callable[[DataFrame], DataFrame]


@dataclass
class Predictor:
    """Parts of a prediction; each works on all questions at once.

    generators: each takes questions (qid, question, db_id, evidence, schema_text, prompt) and gives (qid,
    reply); a generator that raises is left out (failures says why), as is a question without a reply. schema: db_id, schema_text.
    examples(questions) gives (qid, examples) for the prompts, and values(questions) gives (qid, hints), lines of
    values that a question may mean (see vectors.value_hints), which follow the schema. judge and fix (see repair)
    look over candidates in rounds, with answers kept under folder; without them only queries that fail are
    repaired, by rules. method: tournament or self_consistency.
    """

    spark: SparkSession
    generators: list[Generator]
    schema: DataFrame | None = None
    examples: Callable[[DataFrame], DataFrame] | None = None
    values: Callable[[DataFrame], DataFrame] | None = None
    judge: repair.Ask | None = None
    fix: repair.Ask | None = None
    folder: str | None = None
    style: str = "direct"
    method: str = "tournament"
    rounds: int = 3
    timing: dict[str, float] = field(default_factory=dict)
    #: What generators that raised said, by their number.
    failures: dict[int, str] = field(default_factory=dict)
    _kept: list[DataFrame] = field(default_factory=list)

    def _timed(self, stage: str, work: Callable[[], DataFrame]) -> DataFrame:
        start = time.time()
        out = work().persist()
        self._kept.append(out)
        out.count()
        self.timing[stage] = round(self.timing.get(stage, 0.0) + time.time() - start, 3)
        return out

    def _prompts(self, questions: DataFrame) -> DataFrame:
        rows = questions.withColumn("evidence", F.coalesce("evidence", F.lit("")))
        rows = rows.join(F.broadcast(self.schema), "db_id", "left") if self.schema is not None else rows.withColumn("schema_text", F.lit(""))
        rows = rows.withColumn("schema_text", F.coalesce("schema_text", F.lit("")))
        if self.values is None:
            return rows
        return rows.join(self.values(rows).select("qid", "hints"), "qid", "left").withColumn("schema_text", F.concat_ws("\n\n", "schema_text", "hints")).drop("hints")

    def _with_examples(self, rows: DataFrame) -> DataFrame:
        none = F.from_json(F.lit("[]"), "array<struct<question:string,sql:string,reasoning:string>>")
        found = rows.join(self.examples(rows), "qid", "left").withColumn("examples", F.coalesce("examples", none)) if self.examples else rows.withColumn("examples", none)
        return found.withColumn("prompt", text.example_question(F.col("schema_text"), F.col("question"), F.col("evidence"), F.col("examples"), self.style))

    def _candidates(self, rows: DataFrame) -> DataFrame:
        from ..functions.sql_parse import extract_sql

        out = None
        for i, generate in enumerate(self.generators):
            try:
                made = generate(rows).select("qid", F.lit(i).alias("i"), extract_sql(F.col("reply")).alias("sql")).filter(F.trim("sql") != "").persist()
                self._kept.append(made)
                made.count()
            except Exception as e:  # a generator that fails leaves its candidates out
                self.failures[i] = str(e)[:500]
                continue
            out = made if out is None else out.unionByName(made)
        fallback = rows.select("qid", F.lit(len(self.generators)).alias("i"), F.lit(NOTHING).alias("sql"))
        return fallback if out is None else out.unionByName(fallback.join(out.select("qid"), "qid", "left_anti"))

    def _refined(self, candidates: DataFrame, rows: DataFrame) -> DataFrame:
        keyed = candidates.withColumn("key", F.concat_ws(":", "qid", "i"))
        if self.judge is not None or self.fix is not None:
            samples = keyed.join(rows.select("qid", "question", "db_id", "schema_text"), "qid").select(F.col("key").alias("qid"), "question", "db_id", "schema_text", F.col("sql").alias("SQL"))
            mended = repair.repair(samples, self.folder or files.passing_folder(self.spark, "repair"), self.judge, self.fix, self.rounds)
            return keyed.drop("sql").join(mended.select(F.col("qid").alias("key"), F.col("SQL").alias("sql")), "key").select("qid", "i", "sql")
        done = execute.refine(self.spark, keyed, "key", "sql", self.rounds).select("key", F.col("sql").alias("fixed"))
        return keyed.join(done, "key").select("qid", "i", F.col("fixed").alias("sql"))

    def _selected(self, candidates: DataFrame, questions: DataFrame) -> DataFrame:
        def page_facts(page: list) -> list[tuple]:
            known = execute.fingerprints(self.spark, [r["sql"] for r in page])
            return [(r["qid"], r["i"], r["sql"], known[r["sql"]].status, known[r["sql"]].rows, known[r["sql"]].key) for r in page]

        kind = candidates.schema["qid"].dataType.simpleString()
        facts = execute.gathered(self.spark, map(page_facts, execute.pages(candidates.select("qid", "i", "sql"))), f"qid {kind}, i int, sql string, status string, n_rows long, key string")
        if self.method == "tournament":
            scored = facts.join(questions.select("qid", "question"), "qid").withColumn("score", text.result_score(F.col("status"), F.col("n_rows"), F.col("sql"), F.col("question")))
            best = vote.tournament(scored.select("qid", "i", "score"))
        else:
            best = vote.majority(facts.select("qid", "i", "key"))
        alone = facts.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("i", "sql"))).alias("c"))
        return best.select("qid", "i").join(facts, ["qid", "i"]).join(alone, "qid").select(
            "qid", "sql", F.transform("c", lambda x: x["sql"]).alias("candidates"), F.when(F.col("n") == 1, "single").otherwise(self.method).alias("selected_method"), (F.col("key") != ERROR_KEY).alias("runs")
        )

    def predict_batch(self, questions: DataFrame) -> DataFrame:
        """qid, question, db_id, evidence, sql, candidates, selected_method, runs, for each question (qid, question, db_id, evidence).

        A question without text or database is answered by NOTHING with the method error and no candidates.
        Seconds of each stage are in timing, with total and mean a question.
        """
        self.timing, self.failures = {}, {}
        whole = text.present(F.col("question")) & text.present(F.col("db_id"))
        good, bad = questions.filter(whole), questions.filter(~F.coalesce(whole, F.lit(False)))
        rows = self._timed("schema", lambda: self._prompts(good))
        rows = self._timed("icl_retrieval", lambda: self._with_examples(rows))
        made = self._timed("generation", lambda: self._candidates(rows))
        fixed = self._timed("refinement", lambda: self._refined(made, rows))
        best = self._timed("selection", lambda: self._selected(fixed, rows))
        n = questions.count()
        self.timing["total"] = round(sum(self.timing[s] for s in STAGES), 3)
        self.timing["mean"] = round(self.timing["total"] / max(n, 1), 3)
        failed = bad.select("qid", "question", "db_id", "evidence", F.lit(NOTHING).alias("sql"), F.array().cast("array<string>").alias("candidates"), F.lit("error").alias("selected_method"), F.lit(True).alias("runs"))
        out = files.settled(good.select("qid", "question", "db_id", "evidence").join(best, "qid").unionByName(failed))
        for stage in self._kept:  # nothing reads the stages any more
            stage.unpersist()
        self._kept.clear()
        return out

    def predict(self, question: str, db_id: str, evidence: str = "") -> dict:
        """The answer to one question, with its candidates, method and times."""
        one = self.spark.createDataFrame([(0, question, db_id, evidence)], "qid int, question string, db_id string, evidence string")
        row = self.predict_batch(one).first()
        return {"sql": row["sql"], "candidates": row["candidates"], "selected_method": row["selected_method"], "timing": dict(self.timing), "time_seconds": self.timing["total"]}
