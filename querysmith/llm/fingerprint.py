"""Document fingerprints by consistent weighted sampling, and comparison with edited and next texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, map_arrow, record, settle, slices

#: Samples of a fingerprint; rows of the table of sampled terms that a worker keeps; bytes of texts handled at once.
SAMPLES, TABLE, GROUP_BYTES = 64, 300_000, 1 << 20
WORDS = re.compile(WORD).findall
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Rows(dict):
    """Rows of a table by key; a key that is new gets the next row and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[tuple[str, int]] = []

    def __missing__(self, key: tuple[str, int]) -> int:
        row = self[key] = len(self)
        self.fresh.append(key)
        return row


class Sampler:
    """Improved consistent weighted sampling: for each sample and term, r and c ~ Gamma(2, 1), beta ~ U(0, 1).

    With t = floor(ln w / r + beta), the term with the least ln c - r (t - beta + 1) is taken, and the
    sample is (term, t), here as 16 bits. Two texts agree in a sample with a probability that is the
    generalised Jaccard similarity of their word counts.
    """

    def __init__(self, samples: int = SAMPLES):
        self.k = samples
        self.rows = Rows()
        self.cost = np.empty((1024, samples), np.float32)
        self.value = np.empty((1024, samples), np.uint16)
        self.streams = [mix(np.arange(1, samples + 1, dtype=np.uint64) * GOLD + np.array([j], np.uint64) * M1) for j in range(3)]

    def learn(self, keys: list[tuple[str, int]], start: int) -> None:
        """Costs and values of keys in rows from start on."""
        while len(self.cost) < start + len(keys):
            self.cost = np.concatenate([self.cost, np.empty_like(self.cost)])
            self.value = np.concatenate([self.value, np.empty_like(self.value)])
        small = lambda x: (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)
        for i in range(0, len(keys), 512):
            part = keys[i : i + 512]
            term = np.array([xxhash.xxh64_intdigest(w) for w, _ in part], np.uint64)[:, None]
            weight = np.log(np.array([n for _, n in part], np.float32))[:, None]
            # Two uniforms of 23 bits from each 64-bit hash, all of them whole numbers that 32-bit floats hold.
            drawn = [mix(term ^ s) for s in self.streams]
            u = [small((m >> np.uint64(shift)).astype(np.uint32) & np.uint32(0x7FFFFF)) for m in drawn for shift in (0, 40)]
            r, ln_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
            t = np.floor(weight / r + u[4])
            at = slice(start + i, start + i + len(part))
            self.cost[at] = ln_c - r * (t - u[4] + np.float32(1))
            self.value[at] = mix(term + t.astype(np.int64).view(np.uint64) * GOLD + np.uint64(1)) >> np.uint64(48)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of samples for each text; without words, the row of zeros."""
        if len(self.rows) > TABLE:
            self.__init__(self.k)
        start, find = len(self.rows), self.rows.__getitem__
        bags = [np.fromiter(map(find, bag.items()), np.int64, len(bag)) for bag in (Counter(WORDS(t)) for t in texts)]
        self.learn(self.rows.fresh, start)
        self.rows.fresh = []
        out = np.zeros((len(texts), self.k), np.uint16)
        every = np.arange(self.k)
        for i, rows in enumerate(bags):
            if len(rows):
                out[i] = self.value[rows[self.cost[rows].argmin(0)], every]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_samplers: dict[int, Sampler] = {}


def _rows_of(pairs: list[tuple], prints: np.ndarray, following: np.ndarray, sampler: Sampler) -> list[list]:
    """Columns of COMPARED for (id, text, next text), given the fingerprints of both texts."""
    texts = [edited(text, after) for _, text, after in pairs]
    changed = sampler(texts)
    shown = lambda rows: [p.astype(">u2").tobytes().hex() for p in rows]
    return [
        [i for i, _, _ in pairs], [len(text) for _, text, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in texts], shown(prints), shown(changed),
        [likeness(a, b) for a, b in zip(prints, changed, strict=True)], [likeness(a, b) for a, b in zip(prints, following, strict=True)],
    ]


KIND = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDGES = pa.schema([*KIND, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _compare(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition come in order and are compared with the one after; the partition's first and last row
    are handed on as edges, as the last one's next row lies in another partition."""
    from pyspark import TaskContext

    sampler, part = _samplers.setdefault(samples, Sampler(samples)), TaskContext.get().partitionId()
    last = last_print = None

    def edge(name: str, row: tuple) -> pa.RecordBatch:
        return record(EDGES, [row[0]], *([None] for _ in range(6)), [part], [name], [row[1]])

    for batch in slices(batches):
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
        start = 0
        while start < len(rows):
            end, held = start, 0
            while end < len(rows) and (end == start or held < GROUP_BYTES):
                held += len(rows[end][1])
                end += 1
            group, start = rows[start:end], end
            prints = sampler([t for _, t in group])
            if last is None:
                yield edge("first", group[0])
            else:
                group, prints = [last, *group], np.concatenate([last_print[None], prints])
            last, last_print = group[-1], prints[-1]
            pairs = [(i, text, after) for (i, text), (_, after) in zip(group, group[1:])]  # noqa: B905  one shorter
            if pairs:
                none = [None] * len(pairs)
                yield record(EDGES, *_rows_of(pairs, prints[:-1], prints[1:], sampler), none, none, none)
    if last is not None:
        yield edge("last", last)


def _compare_pairs(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    sampler = _samplers.setdefault(samples, Sampler(samples))
    for batch in slices(batches):
        pairs = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True))
        if pairs:
            yield record(KIND, *_rows_of(pairs, sampler([p[1] for p in pairs]), sampler([p[2] for p in pairs]), sampler))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text (hexadecimal, 16 bits a sample); no shuffle."""
    from pyspark.sql.types import StringType, StructField, StructType

    kept = docs.drop(out)

    def run(batches):
        sampler = _samplers.setdefault(samples, Sampler(samples))
        for batch in slices(batches, text_col):
            prints = sampler([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.astype(">u2").tobytes().hex() for p in prints])], [*batch.schema.names, out])

    return map_arrow(kept, run, StructType([*kept.schema.fields, StructField(out, StringType())]))


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare with both the edited and the next text.

    The next document is the one after in descending id (ties: by a hash of the text; null ids last), and the
    first one after the last. Spark partitions by ranges of (id, hash, row), so that neither repeated ids nor
    repeated rows meet in one task; the first and last row of each range are matched by the range's number.

    A null text is empty; texts without words have the fingerprint of zeros (and are alike); repeated rows
    are neighbours; a single row is its own next; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("r"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("t"), F.col("r")]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 20_000)
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    made = settle(map_arrow(dealt.select("doc_id", "text"), lambda b: _compare(b, samples), COMPARED + ", part int, edge string, text string"))
    edges = made.filter("edge IS NOT NULL")
    # Numbers of ranges only: each is followed by the next one that has rows, the last by the first.
    parts = edges.filter("edge = 'first'").select("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(whole)).alias("next"))
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    across = edges.filter("edge = 'last'").select("part", "doc_id", "text").join(after, "part").join(firsts, "next").select("doc_id", "text", "after")
    names = KIND.names
    return made.filter("edge IS NULL").select(*names).unionByName(map_arrow(across, lambda b: _compare_pairs(b, samples), COMPARED))
