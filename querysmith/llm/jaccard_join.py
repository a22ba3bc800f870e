"""Jaccard join of word n-grams: a MinHash forest whose prefixes are shortened for each text, then exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, pairs, repeats
from .base import bucketed, forget, hot_join, map_arrow, record, settle, slices
from .packing import only

#: Words of a shingle, least similarity, least recall at that similarity, lengths of prefixes from the longest.
SHINGLE, LEAST, RECALL, DEPTHS = 5, Fraction(4, 5), 0.999, (5, 3)
#: Trees on which each length of prefixes is tried, and what it costs to put a text into a group, in comparisons.
TRIED, PLACE = 2, 64
#: Bytes of a shingle's hash in a payload; shared shingles of more members than this go through dense matrices.
BYTES, DENSE = 6, 12
RESULT_COLUMNS = ("doc_id", "class_id", "n_links", "component_id", "kept")


def trees_for(depth: int, least: float, recall: float = RECALL) -> int:
    """Trees with which pairs at the threshold share a prefix of the depth somewhere with the recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - least**depth))) if least < 1 else 1


class Forest:
    """The prefixes of a MinHash forest: for each depth as many trees as the recall needs, shortest depth first.

    Place n of a text's prefixes is a tree at a depth; a tree's longer prefixes continue its shorter ones.
    """

    def __init__(self, least: float = float(LEAST), recall: float = RECALL, depths: tuple[int, ...] = DEPTHS):
        self.depths = sorted(depths)
        self.trees = [trees_for(d, least, recall) for d in self.depths]
        self.starts = [sum(self.trees[:i]) for i in range(len(self.trees) + 1)]
        self.level = np.repeat(np.arange(len(self.depths)), self.trees)
        self.most = max(self.trees)

    def prefixes(self, hashes: np.ndarray) -> np.ndarray:
        """A hash of each prefix (no shingles: of zeros)."""
        labels = signature(hashes, self.most * self.depths[-1]).reshape(self.most, self.depths[-1])
        out, parts = np.arange(1, self.most + 1, dtype=np.uint64), {}
        for i in range(self.depths[-1]):
            out = repeats.mix(out * np.uint64(repeats.BASE) + labels[:, i])
            parts[i + 1] = out
        return np.concatenate([parts[d][:t] for d, t in zip(self.depths, self.trees, strict=True)])


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, an empty one has none."""
    values, _ = repeats.word_hashes(text)
    if not len(values):
        return values
    return np.unique(repeats.window_hashes(repeats.prefix_hash(values), min(size, len(values))))


_seeds: dict[int, np.ndarray] = {}


def signature(hashes: np.ndarray, length: int) -> np.ndarray:
    """The least of each of length rehashed values (no shingles: zeros)."""
    if length not in _seeds:
        _seeds[length] = repeats.mix(np.arange(1, length + 1, dtype=np.uint64) * np.uint64(repeats.BASE)) | np.uint64(1)
    if not len(hashes):
        return np.zeros(length, np.uint64)
    seeds, out = _seeds[length], np.full(length, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        x = hashes[i : i + 2048, None] * seeds
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(0))
    return out


def key_of(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes()).digest()


def _classes(batches: Iterator[pa.RecordBatch], size: int, forest: Forest, smallest: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a task: place, text, key, and prefixes and payload with the first of a key.

    place is the key where there is a payload, so that payloads of a class meet, else the text's digest. A set of
    fewer than `smallest` shingles can't be similar to another set, so it has no prefixes.
    """
    only()
    schema = pa.schema([("place", pa.binary()), ("text", pa.binary()), ("key", pa.binary()), ("hashes", pa.list_(pa.int64())), ("payload", pa.binary())])
    texts: set[bytes] = set()
    keys: set[bytes] = set()
    rows: list[tuple] = []
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            digest = hashlib.md5(text or b"").digest()
            if digest in texts:
                continue
            texts.add(digest)
            s = shingles(text or b"", size)
            key = key_of(s)
            fresh = key not in keys
            keys.add(key)
            rows.append((key, digest, key, (forest.prefixes(s).view(np.int64).tolist() if len(s) >= smallest else []), _pack(s)) if fresh else (digest, digest, key, None, None))
            if len(rows) >= 500:
                yield record(schema, *map(list, zip(*rows, strict=True)))
                rows = []
        if len(texts) > 1 << 20:  # told again by later rows of the same text, which does no harm
            texts.clear()
            keys.clear()
    if rows:
        yield record(schema, *map(list, zip(*rows, strict=True)))


def _pack(s: np.ndarray) -> bytes:
    """Six bytes of each sorted hash as differences, by byte planes, which compress."""
    steps = np.diff(s >> np.uint64(8 * (8 - BYTES)), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(BYTES, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :BYTES] = planes.T
    return np.cumsum(full.reshape(-1).view("<u8"), dtype=np.uint64)


def intersections(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both sides' sets and of all intersections. A shingle of few members adds to its pairs;
    those of many members are multiplied as dense matrices, some columns at a time."""
    same = left is right
    sides = [left] if same else [left, right]
    items = [_unpack(x) for side in sides for x in side]
    sizes = np.array([len(x) for x in items], np.int64)
    flat = np.concatenate(items) if items else np.zeros(0, np.uint64)
    ids, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(items)), sizes)
    n, m = len(left), len(right)
    first = 0 if same else n
    total = np.zeros((n, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    start = np.concatenate([[0], np.cumsum(count)])
    flat_pairs = []
    for c in range(2, DENSE + 1):
        of = np.flatnonzero(count == c)
        if not len(of):
            continue
        members = row[start[of][:, None] + np.arange(c)]
        i, j = np.nonzero(~np.eye(c, dtype=bool)) if same else np.triu_indices(c, 1)
        a, b = members[:, i].ravel(), members[:, j].ravel()
        if not same:  # sorted: the left side's members come first
            cross = (a < n) & (b >= n)
            a, b = a[cross], b[cross]
        flat_pairs.append(a * m + (b - first))
    if flat_pairs:
        total += np.bincount(np.concatenate(flat_pairs), minlength=n * m).reshape(n, m).astype(np.float32)
    heavy = np.flatnonzero(count > DENSE)
    for i in range(0, len(heavy), 2048):
        part = heavy[i : i + 2048]
        at = np.concatenate([np.arange(start[c], start[c + 1]) for c in part])
        dense = np.zeros((len(items), len(part)), np.float32)
        dense[row[at], np.searchsorted(part, column[at])] = 1
        total += dense[:n] @ dense[first : first + m].T
    return sizes[:n], sizes[first : first + m], np.rint(total).astype(np.int64)


def _match(least: Fraction, forest: Forest) -> pairs.Match:
    num, den = least.numerator, least.denominator

    def match(left: pairs.Side, right: pairs.Side, number: int) -> np.ndarray:
        same = left is right
        a, b, both = intersections(left.payloads, left.payloads if same else right.payloads)
        similar = both * (num + den) >= num * (a[:, None] + b[None, :])
        similar &= left.asks[:, None] | right.asks[None, :]
        i, j = np.nonzero(similar)
        if len(i):
            x, y = (np.frombuffer(b"".join(side.marks), ">i8").reshape(len(side.marks), -1) for side in (left, right))
            earlier = np.arange(len(forest.level)) < number
            # Met before: an equal earlier prefix of a depth at which one of the two asks.
            met = (x[i, 1:] == y[j, 1:]) & earlier & ((forest.level == x[i, :1]) | (forest.level == y[j, :1]))
            again = met.any(1)
            similar[i[again], j[again]] = False
        return similar

    return match


def chosen_levels(prefixes: DataFrame, forest: Forest, rows: int) -> DataFrame:
    """key, level: the length of prefixes with which each class asks, as a place in forest.depths.

    Every length reaches the target recall with its number of trees, so a text may start from the longest
    prefix and shorten it until shorter ones cost more. That is found from group sizes: a short prefix needs
    fewer trees, but brings more candidates where many texts share it. Sizes are taken on TRIED trees of each
    length. prefixes: key, n, h of all prefixes; rows: about as many as are tried.
    """
    tried = [n for start, trees in zip(forest.starts, forest.trees, strict=False) for n in range(start, start + min(TRIED, trees))]
    few = prefixes.filter(F.col("n").isin(tried))
    sizes = few.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    level = F.element_at(F.array(*(F.lit(int(x)) for x in forest.level)), F.col("n") + 1)
    trees = F.element_at(F.array(*map(F.lit, forest.trees)), F.col("level") + 1)
    cost = hot_join(few, sizes, "h", rows).withColumn("level", level).groupBy("key", "level").agg(((F.avg("size") + PLACE) * F.first(trees)).alias("cost"))
    return cost.groupBy("key").agg(F.min(F.struct("cost", "level")).alias("best")).select("key", F.col("best.level").alias("level"))


def join(docs: DataFrame, size: int = SHINGLE, least: Fraction = LEAST, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, depths: tuple[int, ...] = DEPTHS, row_col: str | None = None) -> DataFrame:
    """A row for each row of docs: its class, its links and its component among texts of Jaccard least or more.

    Texts with the same set of shingles are one class (class_id: its least id). A class has a signature of
    least hashes, cut into the trees of a forest; classes that share a sorted prefix in some tree are
    verified exactly with integers. Each class asks with prefixes of one length, and every class can be
    found by prefixes of all lengths in use. A length's number of trees is such that pairs at the threshold
    meet with the recall (0.999: 18 trees at depth 5, 10 at depth 3); a class shortens its prefixes as long
    as that lowers what it has to compare (see chosen_levels). Links are counted in documents (copies
    included); component_id is the least id reachable by links, and kept is true for one row of each
    component, that of the least id.

    A null text is empty; all texts without words are copies of each other; a text of fewer words than a
    shingle is one shingle; null ids count as the largest; among rows with equal ids one is kept; an
    empty table gives no rows; other columns are ignored.
    Returns rid, doc_id, class_id, n_links, component_id, kept; rid is the unique number in row_col, or, without
    one, a number given here.
    """
    forest = Forest(float(least), recall, depths)
    smallest = math.ceil(least / (1 - least)) if least < 1 else 1 << 62  # m of m + 1 shingles are the most that unequal sets share
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number: Column = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    texts = docs.select(number.alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    members = settle(texts.select("rid", "id", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))).alias("text")))
    made = map_arrow(texts.select("text"), lambda b: _classes(b, size, forest, smallest), "place binary, text binary, key binary, hashes array<long>, payload binary")
    table = bucketed(made.repartition(parts, "place"), "place", parts, "texts")
    n = members.count()
    keys = table.select("text", "key").distinct()
    members = settle(hot_join(members, keys, "text", n).select("rid", "id", "key"))
    one = table.filter("payload IS NOT NULL")
    hashes = one.groupBy("place").agg(F.first("hashes").alias("hashes")).withColumnRenamed("place", "key")
    prefixes = hashes.select("key", F.posexplode("hashes").alias("n", "h"))
    levels = chosen_levels(prefixes, forest, n * TRIED * len(forest.depths))
    own = settle(hashes.filter(F.size("hashes") > 0).join(levels, "key").select("key", "level", "hashes"))
    level = F.element_at(F.array(*(F.lit(int(x)) for x in forest.level)), F.col("n") + 1)
    groups = own.select("key", "level", F.posexplode("hashes").alias("n", "h")).select("key", "n", "h", (level == F.col("level")).alias("asks"))
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("mult"))
    mark = F.concat(*(_eight(x) for x in (F.col("level").cast("long"), *(F.col("hashes")[i] for i in range(len(forest.level))))))
    marks = own.select("key", mark.alias("mark")).join(counts, "key")
    reps = one.groupBy("place").agg(F.first("payload").alias("payload")).withColumnRenamed("place", "key").join(marks.hint("shuffle_hash"), "key")
    found = settle(pairs.linked(reps, groups, _match(least, forest), n * len(forest.level)))
    forget(table)
    forget(own)
    return result(members, found, n)


def _eight(x: Column) -> Column:
    """A long as its eight bytes, big end first."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def result(members: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Members (rid, id, key) with their class, links and component, given found (key, links, root); rows: of members."""
    roots = components.components(found, "key", "root")
    own = members.groupBy("key").agg(F.count(F.lit(1)).alias("mult"), F.min(F.struct(F.coalesce("id", F.lit(repeats.LAST)).alias("k"), "rid", "id")).alias("first"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = own.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = settle(known.select("key", "root", "first", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    full = hot_join(known, heads, "root", rows).select("key", "n_links", F.col("first.id").alias("class_id"), F.col("head.id").alias("component_id"), F.col("head.rid").alias("keeper"))
    return hot_join(members, full, "key", rows).select("rid", F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", (F.col("rid") == F.col("keeper")).alias("kept"))
