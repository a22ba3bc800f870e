"""A corpus pipeline: quality filter, near-duplicate removal, byte-level repeat removal, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysmith.llm import jaccard_join, packing, quality, suffix_dedup
from querysmith.llm.base import release_all_but, scope, settle, table


def _free(name: str, columns: list[str]) -> str:
    """A column name that the input doesn't have."""
    while name in columns:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels outside the held-out fold, takes for good ones.

    The labels' texts come from docs, so the stage depends on its own input and the labels only. A null text
    is scored as an empty one; rows with null ids are scored but never learnt from; repeated rows are judged
    alike; columns keep their names and values, whatever they are called; an empty table gives no rows.
    """
    held = quality.held_out("doc_id", folds=3, fold=1)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    score = _free("score", docs.columns)
    return quality.score(docs, weights, out=score).filter(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that is linked by Jaccard 0.8 or more of word 5-grams.

    Rows are numbered once, in a written copy, by which they are found again. All texts without words, null
    ones included, are one group; rows with null ids come after all others; of repeated rows one stays; columns
    keep their names and values; an empty table gives no rows.
    """
    row = _free("row", docs.columns)
    with scope() as made:
        numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
        kept = settle(jaccard_join.join(numbered, row_col=row).filter("kept").select(F.col("rid").alias(row)))
    release_all_but(made, numbered, kept)
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes covered by 50-byte strings that a document with a smaller id has too.

    A null text becomes an empty one; a null id counts as larger than all others; repeated rows don't remove
    from each other; n_chars is counted anew and all other columns keep their values; an empty table gives no rows.
    """
    clean = suffix_dedup.remove_repeats(docs, rewrite=True)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row for each piece of a document.

    A null text is an empty one, which is a piece with the end id alone; null ids are kept; repeated rows are
    pieces of their own; columns other than doc_id and text are left out; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("jaccard_join", near_duplicates), ("suffix_dedup", repeated_bytes), ("packing", pack)]
#: Training and tokenizing can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, and what it left behind is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        with scope() as made:
            done = settle(stage(spark, docs, sf_dir))
        release_all_but(made, done)
        docs = done
    return docs
