"""Exact top-k by inner product: a KD-tree for each shard, searched best first with a k-th score that is handed on."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import map_arrow, record, settle

#: Hits of a query, steps of a component, rows of a shard at most, rows of a leaf at most.
K, STEPS, SHARD, LEAF = 20, 64, 1 << 18, 128
#: Products that doubles (and so the fast matrix product) add without rounding stay below this.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Queries that a tree's bounds are worked out for together.
BLOCK = 256


def shards_of(rows: int, most: int = SHARD) -> int:
    """Shards grow with the square root of the rows, so that a query's copies and a shard's size both stay small,
    and beyond that so that none holds more than `most` rows on average."""
    return max(1, math.ceil(math.sqrt(rows) / 8), math.ceil(rows / most))


def quantised(vector: list | None, steps: int = STEPS) -> list[int] | None:
    """floor(steps * x) of each component; None for a vector that takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(steps * x) if math.isfinite(steps * x) else steps * int(x) for x in vector]


def clipped(scores: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(scores, LEAST), MOST) if scores.dtype == object else scores


class Tree:
    """KD-tree of whole numbers: median splits of the widest side, tight boxes, leaves of LEAF rows at most.

    Equal vectors are one point that keeps its k + 1 smallest ids, as no query can use more of them (one may be
    its own row). Numbers are doubles while products are exact in them, and Python's integers after lift().
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int):
        order = np.lexsort((rids, ids, *points.T))
        points, at = points[order], np.arange(len(points))
        fresh = at == 0
        fresh[1:] |= (points[1:] != points[:-1]).any(1)
        few = at - np.maximum.accumulate(np.where(fresh, at, 0)) <= k
        self.points, self.ids, self.rids = points[few], ids[order][few], rids[order][few]
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int] | None] = []
        self.inside: list[np.ndarray] = []
        self._grow(np.arange(len(self.points)))
        self._settle()

    def _settle(self) -> None:
        self.low, self.high = (np.array([b[i] for b in self.boxes], self.points.dtype) for i in (0, 1))
        self.leaves = [(self.points[at], self.ids[at], self.rids[at]) for at in self.inside]

    def lift(self) -> None:
        if self.points.dtype != object:
            self.points = self.points.astype(np.int64).astype(object)
            self.boxes = [tuple(x.astype(np.int64).astype(object) for x in b) for b in self.boxes]
            self._settle()

    def _grow(self, at: np.ndarray) -> int:
        node, points = len(self.boxes), self.points[at]
        low, high = points.min(0), points.max(0)
        self.boxes.append((low, high))
        self.children.append(None)
        self.inside.append(at)
        if len(at) > LEAF and (high > low).any():
            values = points[:, int(np.argmax(high - low))]
            middle = np.sort(values)[len(at) // 2]
            left = values < middle if (values < middle).any() else values <= middle
            self.inside[node] = at[:0]
            self.children[node] = self._grow(at[left]), self._grow(at[~left])
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest product that a point of each node's box can have with each query (queries x nodes)."""
        return clipped(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T)

    def search(self, query: np.ndarray, bounds: list, own: int, k: int, least: float) -> list[tuple[int, int, int]]:
        """The k best (-score, id, rid) of a score of `least` or more, best first. The box with the highest bound
        is opened next, until none reaches the k-th score. Equal scores still count, as ids decide ties."""
        found: list[tuple[int, int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if (two := self.children[node]) is not None:
                for child in two:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows, ids, rids = self.leaves[node]
            scores = clipped(rows @ query)
            good = np.nonzero(scores >= least)[0]
            if len(good):
                found += [(-int(s), i, r) for s, i, r in zip(scores[good].tolist(), ids[good].tolist(), rids[good].tolist(), strict=True) if r != own]
                found.sort()
                del found[k:]
                if len(found) == k:
                    least = max(least, -found[-1][0])
        return found


def _rows(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as whole numbers: packed 32-bit ones, or as text (form: number of components, negative then)
    where those don't hold them or doubles don't add their products exactly."""
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("asks", pa.bool_()), ("form", pa.int32()), ("v", pa.binary())])
    for batch in batches:
        out: list[tuple] = []
        for rid, i, asks, v in zip(*(batch.column(n).to_pylist() for n in ("rid", "id", "asks", "v")), strict=True):
            if (x := quantised(v, steps)) is not None:
                largest = max(map(abs, x), default=0)
                small = largest < 1 << 31 and len(x) * largest**2 < EXACT
                out.append((rid, i, asks, len(x) if small else -len(x), np.array(x, "<i4").tobytes() if small else " ".join(map(str, x)).encode()))
        yield record(schema, *(map(list, zip(*out, strict=True)) if out else [[]] * 5))


def matrix(rows: list[tuple[int, bytes]], exact: bool) -> np.ndarray:
    """Vectors (form, packed) of one length as doubles, or as Python's integers."""
    if not exact:
        return np.frombuffer(b"".join(v for _, v in rows), "<i4").reshape(len(rows), rows[0][0]).astype(np.float64)
    return np.array([[int(x) for x in (v.split() if form < 0 else np.frombuffer(v, "<i4"))] for form, v in rows], object).reshape(len(rows), abs(rows[0][0]))


#: A row of a shard: row number, id (MOST where there is none), form, packed vector, least score that counts.
Row = tuple[int, int, int, bytes, int | None]


def plant(points: list[Row], k: int) -> dict[int, Tree]:
    """A tree for each length of vectors."""
    trees = {}
    for dim in {abs(r[2]) for r in points}:
        rows = [r for r in points if abs(r[2]) == dim]
        trees[dim] = Tree(matrix([r[2:4] for r in rows], any(r[2] < 0 for r in rows)), *(np.array([r[i] for r in rows], np.int64) for i in (1, 0)), k)
    return trees


def answers(trees: dict[int, Tree], queries: list[Row], k: int) -> list[tuple]:
    out = []
    for dim in trees:
        mine = [q for q in queries if abs(q[2]) == dim]
        if not mine:
            continue
        tree = trees[dim]
        if any(q[2] < 0 for q in mine):
            tree.lift()
        vectors = matrix([q[2:4] for q in mine], tree.points.dtype == object)
        for q, vector, bound in zip(mine, vectors, tree.bounds(vectors).tolist(), strict=True):
            hits = tree.search(vector, bound, q[0], k, -math.inf if q[4] is None else q[4])
            out += [(q[0], q[1], -s, i, rid) for s, i, rid in hits]
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, a shard's points before its queries, so a task holds one shard and a block of queries."""
    schema = pa.schema([(n, pa.int64()) for n in ("query", "query_id", "score", "vec_id", "rid")])
    shard, points, queries, trees = None, [], [], {}
    for batch in batches:
        found: list[tuple] = []
        for s, asks, *row in zip(*(batch.column(n).to_pylist() for n in ("shard", "asks", "rid", "id", "form", "v", "least")), strict=True):
            if s != shard or len(queries) == BLOCK:
                found += answers(trees, queries, k)
                queries.clear()
            if s != shard:
                shard, trees = s, {}
                points.clear()
            if not asks:
                points.append(tuple(row))
                continue
            if points:
                trees = plant(points, k)
                points.clear()
            queries.append(tuple(row))
        if found:
            yield record(schema, *map(list, zip(*found, strict=True)))
    if found := answers(trees, queries, k):
        yield record(schema, *map(list, zip(*found, strict=True)))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", steps: int = STEPS, shard_rows: int = SHARD) -> DataFrame:
    """The k rows with the highest inner product of floor(steps * component) for each query row, exactly.

    Rows are dealt to shards evenly by a hash of their row number, so copies of one vector are spread. Each shard
    builds a KD-tree. A query first searches the shard it lies in; its k-th score there goes with it to all
    other shards, where boxes that can't reach it are never opened and worse rows never leave the task. A query
    moves once to each shard (their number grows with the square root of the rows), a row twice; a task holds
    a shard's tree and a block of queries. At most k rows a query and shard are merged by Spark.

    A query's own row is left out; rows with equal vectors or equal ids are rows of their own. Vectors that are
    null or hold null or non-finite components take no part; vectors of different lengths aren't
    compared (empty ones score 0 with each other). Ties go to the smaller id, null ids last, then to the row
    read first. Fewer than k other rows give fewer hits, an empty table none. Scores beyond 64 bits count as the
    nearest long. Other columns are ignored; is_query is evaluated on the given frame, null counts as false.
    Returns query_id, rank, vec_id, score.
    """
    given = vectors.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(MOST)).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = settle(map_arrow(given, lambda b: _rows(b, steps), "rid long, id long, asks boolean, form int, v binary"))
    shards = shards_of(rows.count(), shard_rows)
    own = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    points = rows.select(own.alias("shard"), F.lit(False).alias("asks"), "rid", "id", "form", "v", F.lit(None).cast("long").alias("least"))
    asking = rows.filter("asks")

    def round_(queries: DataFrame) -> DataFrame:
        dealt = points.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "rid")
        return map_arrow(dealt, lambda b: _search(b, k), "query long, query_id long, score long, vec_id long, rid long")

    near = settle(round_(asking.select(own.alias("shard"), F.lit(True).alias("asks"), "rid", "id", "form", "v", F.lit(None).cast("long").alias("least"))))
    kth = near.groupBy("query").agg(F.when(F.count("score") == k, F.min("score")).alias("least"))
    elsewhere = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != own))
    far = round_(asking.join(kth, asking["rid"] == kth["query"], "left").select(elsewhere.alias("shard"), F.lit(True).alias("asks"), "rid", "id", "form", "v", "least"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    shown = lambda c: F.when(F.col(c) != MOST, F.col(c))
    return ranked.select(shown("query_id").alias("query_id"), "rank", shown("vec_id").alias("vec_id"), "score")
