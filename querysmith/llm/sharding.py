"""Proportional stratified interleaving into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import bucket_count, ranked
from .base import hash60, settle


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", strata_col: str = "source") -> DataFrame:
    """Deal all rows into shards whose row counts differ by one at most and whose mixture matches the whole.

    Rows of a stratum are ranked by a seeded hash; row r of n gets the fractional rank (r - 0.5) / n; all
    rows are sorted by it (then stratum, hash, id) and cut into equal runs. Each rank is taken in hash
    buckets plus prefix sums of bucket counts, so a stratum with a third of the rows, or the global
    order, never meets in one task. Only ids, sizes and hashes are shuffled, never texts.

    Null strata form a stratum of their own; null ids hash as the word null; a null text has size 1 and
    the CRC of no bytes; repeated rows are interchangeable and each keeps its own slot; an empty table
    gives no rows; other columns are ignored.
    Returns id, stratum, size, text_crc32, shard, slot (gapless from 0 in each shard).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = settle(
        docs.select(
            F.col(id_col),
            F.col(strata_col).alias("__stratum"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hash60(F.lit(seed), F.col(id_col)).alias("__h"),
        )
    )
    rows = narrow.count()
    buckets = bucket_count(rows)
    ties = [F.col("__h"), F.col(id_col), F.col("text_crc32"), F.col("size")]
    within = ranked(narrow, ["__stratum"], F.floor(F.col("__h") / F.lit((1 << 60) // buckets)), ties, "__rank", "__n")
    placed = settle(within.withColumn("__f", (F.col("__rank") - 0.5) / F.col("__n")).withColumn("__all", F.lit(0)))
    order = [F.col("__f"), F.col("__stratum"), *ties]
    whole = ranked(placed, ["__all"], F.floor(F.col("__f") * buckets), order, "__g", "__rows")
    out = whole.withColumn("shard", F.expr(f"cast((__g - 1) * {shards} div __rows as int)"))
    slot = F.expr(f"cast(__g - 1 - (shard * __rows + {shards - 1}) div {shards} as long)")
    return out.select(F.col(id_col), F.col("__stratum").alias(strata_col), "size", "text_crc32", "shard", slot.alias("slot"))
