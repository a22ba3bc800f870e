"""Exact cosine search that skips cells of vectors: sampled centres, radii, and each query's own k-th hit as a bound."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from ..session import importable
from ..sources import files

#: Centres at most, entries for each of them at least, entries of a block of a cell, queries that a block meets at once.
CENTRES, PER_CENTRE, BLOCK, TOGETHER = 256, 64, 16_384, 256
#: By how much rounding may move an angle or a distance.
SLACK = 1e-7


def unit(v: list | None) -> np.ndarray | None:
    """A vector of length one in the same direction; None for a vector that has none."""
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    x = np.array(v, np.float64)
    largest = np.abs(x).max()
    if not largest:
        return None
    x = np.ldexp(x, -int(np.frexp(largest)[1]))
    return x / math.sqrt(x @ x)


def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def distance(q: np.ndarray, v: np.ndarray) -> float:
    """1 - cosine, the products added one after another in double precision, as Spark's aggregate() does."""
    dot = lambda a, b: float(np.add.accumulate(a * b)[-1])
    return 1.0 - dot(q, v) / (math.sqrt(dot(q, q)) * math.sqrt(dot(v, v)))


def sampled(entries: DataFrame, n: int) -> list[np.ndarray]:
    """Centres: the vectors of the n entries with the least hashes of their ids, by dimension."""
    rows = entries.filter("v IS NOT NULL").select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(n).collect()
    found: dict[int, list] = {}
    for r in rows:
        if (x := unit(r["v"])) is not None:
            found.setdefault(len(x), []).append(x)
    return [np.stack(x) for x in found.values()]


def placed(rows: DataFrame, id_col: str, v_col: str, centres: list[np.ndarray], every: bool) -> DataFrame:
    """Usable rows with the cell of their nearest centre and their angle to it (dim, cell, angle); or, without their
    vectors, with every centre's (every). A vector of a length that no centre has is in the cell -1 of its length."""
    fields = [f for f in rows.schema.fields if f.name != v_col or not every]
    schema = StructType([*fields, StructField("dim", IntegerType()), StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    by = {c.shape[1]: c for c in centres}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(v) for v in batch.column(v_col).to_pylist()]
            at, dims, cells, far = [], [], [], []
            for dim in {len(u) for u in units if u is not None}:
                mine = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
                if dim not in by:
                    at += mine
                    dims += [dim] * len(mine)
                    cells += [-1] * len(mine)
                    far += [0.0] * len(mine)
                    continue
                a = angles(np.stack([units[i] for i in mine]), by[dim])
                if every:
                    at += np.repeat(mine, a.shape[1]).tolist()
                    cells += np.tile(np.arange(a.shape[1]), len(mine)).tolist()
                    far += a.ravel().tolist()
                    dims += [dim] * a.size
                else:
                    nearest = a.argmin(1)
                    at += mine
                    cells += nearest.tolist()
                    far += a[np.arange(len(mine)), nearest].tolist()
                    dims += [dim] * len(mine)
            taken = batch.take(pa.array(at, pa.int64()))
            columns = [*(taken.column(f.name) for f in fields), pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(far, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    importable(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _search(batches: Iterator[pa.RecordBatch], k: int, kinds: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, its entries before the queries that visit it; a task holds one block."""
    block, entries, queries = None, [], []
    matrix = norms = None
    out: tuple[list, list, list] = ([], [], [])

    def answer() -> None:
        nonlocal matrix, norms
        if not queries or not entries:
            queries.clear()
            return
        if matrix is None:
            matrix = np.stack([v for _, v in entries])
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        q = np.stack([v for _, v, _ in queries])
        rough = 1 - (q @ matrix.T) / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] / norms
        for (qid, vector, least), row in zip(queries, rough, strict=True):
            bound = min(math.inf if least is None else least, np.partition(row, k)[k] if len(row) > k else math.inf)
            hits = [(distance(vector, entries[i][1]), entries[i][0]) for i in np.nonzero(row <= bound + SLACK)[0].tolist() if entries[i][0] != qid]
            for d, i in sorted(hits)[:k]:
                out[0].append(qid)
                out[1].append(i)
                out[2].append(d)
        queries.clear()

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.float64())], ["qid", "id", "distance"])
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for number, qid, i, v, bound in zip(*(batch.column(n).to_pylist() for n in ("block", "qid", "id", "v", "bound")), strict=True):
            if number != block:
                answer()
                block, matrix = number, None
                entries.clear()
            if i is not None:
                entries.append((i, np.array(v, np.float64)))
            else:
                queries.append((qid, np.array(v, np.float64), bound))
                if len(queries) == TOGETHER:
                    answer()
        if out[0]:
            yield emit()
    answer()
    if out[0]:
        yield emit()


@dataclass
class Search:
    """What a search has to look at: entries with their cells, cells with radius and size, queries with their angles."""

    entries: DataFrame
    queries: DataFrame
    cells: DataFrame
    asked: DataFrame
    k: int

    def hits(self, report: dict | None = None) -> DataFrame:
        """The k nearest entries of each query, in two rounds; see search."""
        nearest = Window.partitionBy("qid").orderBy("angle", "place")
        ranked = self.asked.withColumn("nth", F.row_number().over(nearest))
        first = self.visit(ranked.filter("nth = 1").withColumn("bound", F.lit(None).cast("double")))
        first = files.settled(first)
        kth = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= self.k, F.max("distance")).alias("bound"))
        rest = ranked.filter("nth > 1").join(kth, "qid", "left")
        reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("bound"))))
        open_ = rest.filter(F.col("bound").isNull() | (F.col("angle") - F.col("radius") <= reach + SLACK))
        if report is not None:
            total = lambda df: df.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            report.update(met=total(ranked.filter("nth = 1")) + total(open_), all=total(self.asked))
        hits = first.unionByName(self.visit(open_))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        return hits.withColumn("rank", rank).filter(F.col("rank") <= self.k)

    def entries_of(self, visits: DataFrame) -> DataFrame:
        """id, v, place of the entries that the visits may need."""
        return self.entries

    def visit(self, visits: DataFrame) -> DataFrame:
        """Hits of visits (qid, bound, place, blocks): a cell's entries are cut into blocks by a hash of their ids,
        which each visitor goes through."""
        id_kind, qid_kind = self.entries.schema["id"].dataType, self.queries.schema["qid"].dataType
        number = lambda salt: F.xxhash64(F.col("place"), salt)
        theirs = self.entries_of(visits).join(self.cells.select("place", "blocks"), "place").select(number(F.pmod(F.xxhash64("id", "v"), "blocks")).alias("block"), F.lit(None).cast(qid_kind).alias("qid"), "id", "v", F.lit(None).cast("double").alias("bound"))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        ours = visits.withColumn("salt", salts).join(self.queries, "qid").select(number(F.col("salt")).alias("block"), "qid", F.lit(None).cast(id_kind).alias("id"), "v", "bound")
        parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = theirs.join(ours.select("block").distinct(), "block", "left_semi").unionByName(ours).repartition(parts, "block").sortWithinPartitions("block", F.col("id").isNull())
        kinds = tuple(pa.schema([_arrow(x)]).field(0).type for x in (qid_kind, id_kind))
        k = self.k
        schema = StructType([StructField("qid", qid_kind), StructField("id", id_kind), StructField("distance", DoubleType())])
        return met.mapInArrow(lambda b: _search(b, k, kinds), schema)


def _arrow(kind: DataType) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field("x", to_arrow_type(kind))


def same_kind(entries: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ids of one type: whole numbers as long, else as text."""
    kinds = {entries.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()}
    if len(kinds) == 1:
        return entries, queries
    both = "bigint" if kinds <= {"int", "bigint"} else "string"
    return entries.withColumn("id", F.col("id").cast(both)), queries.withColumn("qid", F.col("qid").cast(both))


def celled(entries: DataFrame, middle: list[np.ndarray]) -> DataFrame:
    """Entries (id, v, group and others) with dim, cell, angle and place."""
    return placed(entries, "id", "v", middle, every=False).withColumn("place", F.xxhash64("group", "dim", "cell"))


def cell_sizes(own: DataFrame) -> DataFrame:
    """place, group, dim, cell, radius and size of each cell that has entries."""
    return own.groupBy("place", "group", "dim", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size"))


def asking(queries: DataFrame, cells: DataFrame, middle: list[np.ndarray]) -> DataFrame:
    """qid, place, blocks, size, angle, radius, group, cell of each cell that a query (qid, v, group) may visit."""
    met = placed(queries, "qid", "v", middle, every=True).join(cells, ["group", "dim", "cell"])
    return files.settled(met.select("qid", "place", "blocks", "size", "angle", "radius", "group", "cell"))


def prepared(entries: DataFrame, queries: DataFrame, k: int, same: str | None, centres: int, block: int) -> Search:
    entries, queries = same_kind(entries, queries)
    group = F.col(same) if same else F.lit(0)
    entries = entries.filter("id IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"), group.alias("group")).filter("group IS NOT NULL")
    queries = queries.filter("qid IS NOT NULL").select("qid", F.col("q").cast("array<double>").alias("v"), group.alias("group")).filter("group IS NOT NULL")
    middle = sampled(entries, max(1, min(centres, entries.count() // PER_CENTRE)))
    own = files.settled(celled(entries, middle))
    cells = files.settled(cell_sizes(own).withColumn("blocks", F.ceil(F.col("size") / block)))
    return Search(own.select("id", "v", "place"), queries.select("qid", "v"), cells, asking(queries, cells, middle), k)


def search(entries: DataFrame, queries: DataFrame, k: int, same: str | None = None, centres: int = CENTRES, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """The k nearest entries (id, v) of each query (qid, q) by cosine distance: qid, id, distance, rank.

    Entries lie in the cell of their nearest of at most `centres` sampled vectors (within the value of same, if
    given), which has a radius, the largest angle of an entry to its centre. A query first searches the cell whose
    centre is nearest. By the triangle inequality a cell at an angle of more than its radius beyond the query's k-th
    hit can't hold a nearer entry, so only the others are searched in a second round. Large cells are cut into
    blocks of about `block` entries, so that a crowded cell or value of same is spread; a task holds one block and
    few queries. All hits are exact, and near misses of the bound are kept within the rounding error.

    An entry isn't its own hit (id = qid). Vectors that are null, empty or zero or hold null or non-finite components
    have no distance and no hits, nor have vectors of different lengths; null ids take no part; queries hold each
    qid once. Ties: the smaller id. report takes the numbers of pairs that were compared (met) and that there are (all).
    """
    return prepared(entries, queries, k, same, centres, block).hits(report)

