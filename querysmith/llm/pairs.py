"""Verified links between members of hash groups, without emitting pairs.

Classes of equal items (key, multiplicity, payload, mark) meet in groups. A member of a group asks, or is only
there to be found: pairs of which at least one asks are looked at. A group is verified by matrices in one
task; a group of more than TILE classes is split into tiles, and each pair of tiles is a task's group of its
own. A pair that meets in several groups is counted in the first only, which payloads and marks tell. What
leaves a task is a row for each linked member, never a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hot_join, map_arrow, record

#: Classes of a tile, so that a matrix of two tiles' pairs stays small.
TILE = 1024


@dataclass
class Side:
    """Members of one tile: payloads, marks, and which of them ask."""

    payloads: list[bytes]
    marks: list[bytes]
    asks: np.ndarray


Match = Callable[[Side, Side, int], np.ndarray]


def linked(reps: DataFrame, groups: DataFrame, match: Match, rows: int, tile: int = TILE) -> DataFrame:
    """key, links (documents of other classes that are linked), root (a member of the same component).

    reps: key, mult, payload, mark, in buckets of key; groups: key, n (number of the group's kind), h (the
    group), asks; rows: about as many as groups has. match(left, right, n) gives the matrix of linked pairs of
    two sides (one side twice: of all its pairs) that don't meet in a group of a smaller number.
    """
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.count_if("asks").alias("asked"), F.bit_xor(F.xxhash64("key", "asks")).alias("who"), F.min("n").alias("n")).filter("size > 1 AND asked > 0")
    # The same members asking in the same way again find nothing new: the first such group stands for all.
    sizes = sizes.groupBy("who", "size", "asked").agg(F.min(F.struct("n", "h")).alias("first")).select(F.col("first.h").alias("h"), "size", "asked")
    met = hot_join(groups, sizes, "h", rows)
    meetings = met.groupBy("key").agg(F.collect_list(F.struct("n", "h", "asks", "size", "asked")).alias("meetings"))
    members = reps.join(meetings.hint("shuffle_hash"), "key").withColumn("g", F.explode("meetings"))
    asking, others = F.ceil(F.col("g.asked") / tile).cast("int"), F.ceil((F.col("g.size") - F.col("g.asked")) / tile).cast("int")
    spot, small = F.xxhash64("key", "g.h"), F.col("g.size") <= tile
    own = F.when(small, 0).when(F.col("g.asks"), F.pmod(spot, asking)).otherwise(asking + F.pmod(spot, F.greatest(others, F.lit(1)))).cast("int")
    last = F.when(small, 0).when(F.col("g.asks"), asking + others - 1).otherwise(asking - 1)
    placed = members.select("key", "mult", "payload", "mark", "g.n", "g.h", "g.asks", own.alias("own"), last.alias("last"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    paired = paired.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    dealt = paired.repartition(n, "h", "a", "b").sortWithinPartitions("h", "a", "b", "own")
    return map_arrow(dealt.select("key", "mult", "payload", "mark", "n", "h", "asks", "own", "a", "b"), lambda x: _solve(x, match), "key binary, links long, root binary")


def _solve(batches: Iterator[pa.RecordBatch], match: Match) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    now, group = None, []
    names = ("key", "mult", "payload", "mark", "asks", "own")

    def done():
        if len(group) > 1 and (out := _group(group, now, match)):
            yield record(schema, *map(list, zip(*out, strict=True)))

    for batch in batches:
        places = list(zip(*(batch.column(n).to_pylist() for n in ("n", "h", "a", "b")), strict=True))
        for place, row in zip(places, zip(*(batch.column(n).to_pylist() for n in names), strict=True), strict=True):
            if place != now:
                yield from done()
                now, group = place, []
            group.append(row)
    yield from done()


def _group(group: list[tuple], place: tuple, match: Match) -> list[tuple]:
    number, _, a, b = place
    keys, mult = [g[0] for g in group], np.array([g[1] for g in group], np.int64)
    side = lambda part: Side([g[2] for g in part], [g[3] for g in part], np.array([g[4] for g in part], bool))
    full = np.zeros((len(group), len(group)), bool)
    if a == b:
        both = side(group)
        asking = np.flatnonzero(both.asks)
        if len(asking) == len(group):
            full = match(both, both, number)
        elif len(asking):
            found = match(side([group[i] for i in asking]), both, number)
            full[asking] = found
            full[:, asking] |= found.T
        np.fill_diagonal(full, False)
    else:
        left = sum(g[5] == a for g in group)  # sorted by tile
        if not 0 < left < len(group):
            return []
        found = match(side(group[:left]), side(group[left:]), number)
        full[:left, left:] = found
        full[left:, :left] = found.T
    rows = np.flatnonzero(full.any(1))
    if not len(rows):
        return []
    links = full[rows].astype(np.float64) @ mult
    label = np.arange(len(group))
    while True:
        least = np.minimum(label, np.where(full, label[None, :], len(group)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(keys[i], int(n), keys[label[i]]) for i, n in zip(rows, links, strict=True)]
