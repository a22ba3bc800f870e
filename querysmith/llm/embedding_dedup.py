"""Embedding near-dedup: collisions in query-centred windows on many sorted projections, then exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join, pairs, repeats
from .base import bucketed, forget, map_arrow, record, settle

#: Least cosine, least recall of pairs at it, collisions that a pair needs, vectors that a window aims to hold.
COSINE, RECALL, COLLISIONS, WINDOW = 0.9, 0.997, 2, 256
#: Half width of a window, in deviations of the difference of two projections at the least cosine.
REACH = 2.0
#: Steps of a unit vector's components and of a direction's, so that projections are whole numbers and exact.
UNIT, DIRECTION = 1 << 14, 1 << 6


def passing(lines: int, least: int, p: float) -> float:
    """Probability of at least `least` collisions on so many lines."""
    return 1 - sum(math.comb(lines, i) * p**i * (1 - p) ** (lines - i) for i in range(least))


def calibrate(rows: int, cosine: float = COSINE, recall: float = RECALL, collisions: int = COLLISIONS) -> tuple[int, int, float]:
    """Signs of a stretch, lines, and half width of a window, so that pairs at the cosine pass with the recall.

    A line is a random direction on which all vectors are projected and sorted. The line is cut into
    stretches by the signs of further projections, and vectors are sorted within each, so a window around a
    query, all vectors of its stretch whose projection is within the half width, holds about WINDOW vectors at
    any number of rows. Two vectors at angle a share a stretch with probability (1 - a / pi) ** signs, and
    their projections differ by a normal deviate of 2 sin(a / 2); lines are independent, so counts of
    collisions are binomial. Lines grow with the rows as far as the recall asks for; there is no cap.
    """
    angle = math.acos(cosine)
    width = REACH * 2 * math.sin(angle / 2)
    inside = math.erf(width / 2)  # of two unrelated vectors
    signs = max(2, math.ceil(math.log2(max(2.0, rows * inside / 2 / WINDOW))))
    p = (1 - angle / math.pi) ** signs * math.erf(REACH / math.sqrt(2))
    lines = collisions
    while passing(lines, collisions, p) < recall:
        lines += max(1, lines // 64)
    return signs, lines, width


_directions: dict[tuple[int, int], np.ndarray] = {}


def coordinates(vectors: np.ndarray, lines: int, signs: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Stretch and projection of each vector on each line (rows x lines); the same however vectors are batched,
    as whole numbers are added without rounding."""
    dim, columns = vectors.shape[1], lines * (signs + 1)
    if (dim, columns) not in _directions:
        _directions[dim, columns] = np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, columns)) * DIRECTION)
    units = np.rint(vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None] * UNIT)
    shown = (units @ _directions[dim, columns]).reshape(len(vectors), lines, signs + 1)
    stretch = ((shown[:, :, 1:] >= 0) * (np.uint64(1) << np.arange(signs, dtype=np.uint64))).sum(2).astype(np.uint64)
    return stretch, shown[:, :, 0] / (UNIT * DIRECTION)


def usable(vector: list | None) -> np.ndarray | None:
    """Doubles of a vector that can link: not null, empty or zero, all components finite; scaled by a power of
    two (exactly), so that no sum of squares overflows or vanishes."""
    if not vector or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0


def pack(x: np.ndarray) -> bytes:
    """As 32-bit floats where that loses nothing; the last byte tells."""
    small = x.astype(np.float32)
    return small.tobytes() + b"\x04" if (small == x).all() else x.tobytes() + b"\x08"


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[:-1], np.float32 if blob[-1] == 4 else np.float64).astype(np.float64)


def key_of(vector: list) -> bytes:
    """Equal vectors have equal keys (0.0 and -0.0 are equal)."""
    return hashlib.md5((np.array(vector, np.float64) + 0.0).tobytes()).digest()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, id and key of each vector; the payload with the first of its key in a task. One that can't link is alone."""
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("key", pa.binary()), ("payload", pa.binary())])
    seen: set[bytes] = set()
    for batch in batches:
        keys, payloads = [], []
        for rid, v in zip(batch.column("rid").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x = usable(v)
            key = rid.to_bytes(8, "big") if x is None else key_of(v)
            fresh = x is not None and key not in seen
            seen.add(key)
            keys.append(key)
            payloads.append(pack(x) if fresh else None)
        if len(seen) > 1 << 20:
            seen.clear()
        yield record(schema, batch.column("rid"), batch.column("id"), keys, payloads)


def _groups(batches: Iterator[pa.RecordBatch], lines: int, signs: int, width: float) -> Iterator[pa.RecordBatch]:
    """The cells of a class: on each line its own, where it asks, and the next one, where it can be found."""
    cell = pa.struct([("n", pa.int32()), ("h", pa.int64()), ("asks", pa.bool_())])
    number = np.tile(np.arange(lines, dtype=np.int32), 2)
    asks = np.repeat([True, False], lines)
    for batch in batches:
        vectors = [unpack(p) for p in batch.column("payload").to_pylist()]
        found: list[list] = [[] for _ in vectors]
        for dim in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            stretch, value = coordinates(np.stack([vectors[i] for i in at]), lines, signs)
            line = repeats.mix(stretch + (np.arange(lines, dtype=np.uint64) << np.uint64(48)) + np.uint64(dim * repeats.BASE % (1 << 64)))
            place = np.floor(value / width).astype(np.int64).view(np.uint64)
            both = [repeats.mix(line + (place + np.uint64(i)) * np.uint64(repeats.BASE)).view(np.int64) for i in (0, 1)]
            cells = np.concatenate(both, axis=1)
            for row, i in enumerate(at):
                found[i] = [{"n": int(n), "h": int(h), "asks": bool(a)} for n, h, a in zip(number, cells[row], asks, strict=True)]
        yield record(pa.schema([("key", pa.binary()), ("cells", pa.list_(cell))]), batch.column("key"), pa.array(found, pa.list_(cell)))


def _match(cosine: float, collisions: int, lines: int, signs: int, width: float) -> pairs.Match:
    kind = np.uint8 if signs <= 8 else np.uint16 if signs <= 16 else np.uint32 if signs <= 32 else np.uint64

    def match(left: pairs.Side, right: pairs.Side, number: int) -> np.ndarray:
        same = left is right
        x = np.stack([unpack(p) for p in left.payloads])
        y = x if same else np.stack([unpack(p) for p in right.payloads])
        out = np.zeros((len(x), len(y)), bool)
        if x.shape[1] != y.shape[1]:
            return out
        (sx, vx), (sy, vy) = (coordinates(v, lines, signs) for v in (x, y))
        sx, sy = sx.astype(kind), sy.astype(kind)
        count, before = np.zeros(out.shape, np.uint16), np.zeros(out.shape, bool)
        for i in range(lines):
            a, b = np.nonzero(sx[:, i][:, None] == sy[:, i][None, :])
            near = np.abs(vx[a, i] - vy[b, i]) <= width
            a, b = a[near], b[near]
            count[a, b] += 1
            if i < number:
                before[a, b] = True
            elif i == number:
                here = np.zeros(out.shape, bool)
                here[a, b] = True
        here &= ~before & (count >= collisions) & (left.asks[:, None] | right.asks[None, :])
        a, b = np.nonzero(here)
        nx, ny = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
        for i in range(0, len(a), 50_000):
            at = slice(i, i + 50_000)
            out[a[at], b[at]] = np.einsum("ij,ij->i", x[a[at]], y[b[at]]) / (nx[a[at]] * ny[b[at]]) >= cosine
        return out

    return match


def link(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector: links of cosine or more, component by links, whether it stays.

    Equal vectors are one class. On each line a class is put into the cell of its projection, a cell being as
    wide as a window reaches, and into the next one, so all vectors within reach of a query meet it in one
    cell. A pair's collisions on all lines are counted in the first cell in which it meets, and pairs with
    enough of them are verified in double precision. Large cells are split into tiles; no pair is ever a row.
    A line moves a class's key and its vector (32-bit floats where they lose nothing); coordinates of all
    other lines are computed again from the vector.

    Null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths don't link; null ids count as the largest; rows with equal ids are vectors of
    their own; an empty table gives no rows; other columns are ignored.
    Returns vec_id, n_links, component_id (least id reachable), kept (vec_id is component_id).
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    members = settle(map_arrow(rows, _members, "rid long, id long, key binary, payload binary"))
    n = members.count()
    signs, lines, width = calibrate(n, cosine, recall)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("mult"))
    payloads = members.filter("payload IS NOT NULL").select("key", "payload").repartition(parts, "key").groupBy("key").agg(F.first("payload").alias("payload"))
    reps = bucketed(payloads.join(counts, "key").withColumn("mark", F.lit(None).cast("binary")), "key", parts, "classes")
    cells = map_arrow(reps.select("key", "payload"), lambda b: _groups(b, lines, signs, width), "key binary, cells array<struct<n:int,h:long,asks:boolean>>")
    groups = settle(cells.select("key", F.explode("cells").alias("c")).select("key", "c.*"))
    found = settle(pairs.linked(reps, groups, _match(cosine, COLLISIONS, lines, signs, width), 2 * lines * n))
    forget(reps)
    forget(groups)
    out = jaccard_join.result(members.select("rid", "id", "key"), found, n)
    return out.select(F.col("doc_id").alias("vec_id"), "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
