"""Choice among candidate queries by votes, tournaments and scores, from stored facts about their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compare import ERROR_KEY


def majority(candidates: DataFrame) -> DataFrame:
    """The first member of the largest group of equal results: qid, i, votes.

    candidates: qid, i, key. Groups of failed results don't count; ties go to the group seen first; where
    all have failed, candidate 0 stays with no votes.
    """
    groups = candidates.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("votes"), F.min("i").alias("i"))
    score = F.when(F.col("key") != ERROR_KEY, F.struct(F.col("votes"), (-F.col("i")).alias("minus_i")))
    best = groups.groupBy("qid").agg(F.max(score).alias("s"), F.min("i").alias("least"))
    return best.select("qid", F.coalesce(-F.col("s.minus_i"), F.col("least")).cast("long").alias("i"), F.coalesce(F.col("s.votes"), F.lit(0)).cast("long").alias("votes"))


def tournament(candidates: DataFrame) -> DataFrame:
    """The candidate with most wins over all pairs i < j (equal scores: the first of the pair wins), then the
    higher score, then the lower index: qid, i, wins, score. candidates: qid, i, score; a question has few."""
    a = candidates.select("qid", F.col("i").alias("a"), F.col("score").alias("sa"))
    b = candidates.select("qid", F.col("i").alias("b"), F.col("score").alias("sb"))
    won = a.join(b, "qid").filter("a < b").select("qid", F.when(F.col("sa") >= F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("i")).groupBy("qid", "i").agg(F.count(F.lit(1)).alias("wins"))
    full = candidates.select("qid", "i", "score").join(won, ["qid", "i"], "left").fillna(0, ["wins"])
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("wins"), F.desc("score"), "i"))
    return full.withColumn("r", rank).filter("r = 1").select("qid", "i", "wins", "score")
