"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, hot_join, settle

#: Rounds after which an edge table that still changes is taken for a mistake (they grow with the square of a logarithm).
ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node reachable) of all nodes that an edge between different nodes touches.

    Each step replaces edges by edges to the least neighbour and never adds any; a settled table cuts the
    lineage. A hub's edges stay spread over all tasks (see hot_join). Null ends are left out; repeated edges and loops don't matter; no edges give no rows.
    """
    now = settle(_clean(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    before, rows = None, now.count()
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        pulled = hot_join(both.filter(F.col("v") > F.col("u")), large, "u", rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = _clean(pulled)
        small = wide.groupBy("u").agg(F.min("v").alias("m"))
        stars = wide.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = settle(_clean(stars))
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        forget(now)
        now, rows = after, state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _clean(edges: DataFrame) -> DataFrame:
    """Different ends, the larger one first, once each."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
