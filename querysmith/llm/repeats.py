"""Repeated fixed-length strings across documents: chunks, minimisers, and the exchange of suffix-array dedup.

A string of L symbols is known by its minimiser, the least hash of its k-grams. Equal strings have equal
minimisers, so only runs of strings whose minimiser value occurs in several places can repeat, and a run
whose whole content equals another's repeats altogether. What is left, runs of one minimiser with unequal
contents, goes to the exact step. All of this holds at every size and drops no case.

1. store: documents are put into chunks of a few MB, one row each, in a table bucketed by chunk, so later
   joins by chunk don't shuffle texts.
2. sighted: each chunk sends (minimiser, content hash, least doc) of its distinct runs to buckets of
   minimisers, packed, and gets a flag for each back.
3. resolve: flags become covered intervals, and runs that need the exact step are sent on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bucketed, give_back, importable, map_arrow, record
from .packing import only

#: Bytes of text in a chunk; runs that a bucket of minimisers aims to hold.
CHUNK_BYTES, BUCKET_RUNS = 3 << 20, 400_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LAST = (1 << 63) - 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A symbol's value in hashes; for bytes, 256 values of a fixed generator.
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
NONE, ALL, FIRST = 0, 1, 2  # flags: nothing found; a smaller document has the run; this chunk has the first of several contents


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: The six ASCII white-space bytes; bytes from which a word is hashed on its own, beyond which Rabin-Karp hashes of
#: two symbols could be made to agree.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
LONG_WORD = 512
#: Bytes of text whose words are hashed at once.
BLOCK_BYTES = 1 << 19


def words_of(text: bytes, ends: list[int] | None = None, longest: int = LONG_WORD, digest: Callable = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie behind each other (ends; default: one text): hash, start, end, and each text's number of words.

    Words longer than longest get the digest of their bytes.
    """
    ends = [len(text)] if ends is None else ends
    none = np.zeros(0, np.int64)
    if not text:
        return none.astype(np.uint64), none, none, np.zeros(len(ends), np.int64)
    symbols = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(symbols) + 2, bool)
    inside[1:-1] = ~SPACES[symbols]
    cut = np.zeros(len(symbols) + 1, bool)  # a text starts here
    cut[np.array(ends)] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    length = end - start
    out = np.empty(len(start), np.uint64)
    blocks = np.searchsorted(start, np.arange(0, len(symbols) + BLOCK_BYTES, BLOCK_BYTES))
    for i, j in zip(blocks, blocks[1:]):  # noqa: B905  one shorter
        if i < j:
            first, reach = start[i], np.minimum(length[i:j], LONG_WORD)
            a = start[i:j] - first
            prefix = prefix_hash(BYTE_VALUES[symbols[first : start[j - 1] + reach[-1]]])
            out[i:j] = mix((prefix[a + reach] - prefix[a]) * powers(len(prefix))[1][a] + reach.astype(np.uint64))
    for i in np.flatnonzero(length > longest).tolist():
        out[i] = digest(text[start[i] : end[i]])
    return out, start, end, np.diff(np.searchsorted(start, np.array([0, *ends])))


def word_hashes(text: bytes, ends: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and each text's number of words."""
    out, _, _, counts = words_of(text, ends)
    return out, counts


class Powers:
    """Powers of the base and of its inverse modulo 2**64, kept as long as the longest text so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


powers = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums; (p[e] - p[s]) times the inverse power of s is the hash of values[s:e]."""
    up, _ = powers(len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up)])


def window_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """Mixed Rabin-Karp hashes of all windows of the length."""
    n = len(prefix) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[length:] - prefix[:n]) * powers(n)[1])


def runs_of(values: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: minimiser, content hash, first window, number of windows."""
    if len(values) < length:
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int64), z.astype(np.int64)
    prefix = prefix_hash(values)
    least, span, width = window_hashes(prefix, k), 1, length - k + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        n = len(values) - length + 1
        least = np.minimum(least[:n], least[width - span : width - span + n])
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.append(start, len(least)))
    end = start + count + length - 1
    content = mix(((prefix[end] - prefix[start]) * powers(len(values))[1][start]) ^ (count.astype(np.uint64) << np.uint64(40)))
    # Least values crowd near zero; mixed again they spread evenly over buckets.
    return mix(least[start] ^ np.uint64(BASE)), content, start, count


def store(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Chunks of whole documents: chunk, ids, ends (byte offsets), text (all bytes together), rows.

    rows: with carry all columns but the text of each document, as JSON, else empty.
    """
    spark = docs.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("text", pa.binary()), ("rows", pa.list_(pa.string()))])
        only()
        give_back()
        chunk, ids, parts, rows, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def made():
            return record(schema, [chunk], [ids], [np.cumsum([len(p) for p in parts]).tolist()], [b"".join(parts)], [rows])

        for batch in batches:
            for doc, text, row in zip(*(batch.column(n).to_pylist() for n in ("id", "text", "row")), strict=True):
                if ids and held + len(text or b"") > CHUNK_BYTES:
                    yield made()
                    chunk, ids, parts, rows, held = chunk + 1, [], [], [], 0
                ids.append(doc)
                if row is not None:
                    rows.append(row)
                parts.append(text or b"")
                held += len(parts[-1])
        if ids:
            yield made()

    row = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c != text_col))) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), row.alias("row"))
    packed = map_arrow(rows, chunks, "chunk long, ids array<long>, ends array<long>, text binary, rows array<string>")
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    return bucketed(packed, "chunk", buckets, "chunks")


class Chunk:
    """A chunk's documents as symbol values, with the runs of them all and their distinct (minimiser, content) pairs."""

    def __init__(self, ids: list, ends: list, text: bytes, symbols: Callable, length: int, k: int):
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.texts = [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        runs = [runs_of(symbols(t), length, k) for t in self.texts]
        self.doc = np.repeat(np.arange(len(ids)), [len(r[0]) for r in runs])
        self.h, self.c, self.start, self.count = (np.concatenate([r[i] for r in runs]) if runs else np.zeros(0, np.uint64) for i in range(4))
        order = np.lexsort((self.ids[self.doc], self.c, self.h)) if len(self.h) else np.zeros(0, np.int64)
        h, c = self.h[order], self.c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = order[new]
        self.pair = np.empty(len(h), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.pair_h, self.pair_c, self.pair_id = self.h[first], self.c[first], self.ids[self.doc[first]]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) * buckets >> 24


def _send(batches: Iterator[pa.RecordBatch], symbols: Callable, length: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs are sorted by minimiser, so a bucket's pairs are a stretch; packed by columns as they compress."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("pairs", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in ("chunk", "ids", "ends", "text")}
            chunk = Chunk(row["ids"], row["ends"], row["text"], symbols, length, k)
            if not len(chunk.pair_h):
                continue
            at = bucket_of(chunk.pair_h, buckets)
            edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
            packed = [_pack(chunk.pair_h[a:b], chunk.pair_c[a:b], chunk.pair_id[a:b]) for a, b in zip(edges, edges[1:])]  # noqa: B905
            yield record(schema, at[edges[:-1]].tolist(), [row["chunk"]] * len(packed), packed)


#: Bytes of a run's record: six of its minimiser (false meetings cost time only), its whole content hash, its id.
PLANES = ((2, 8), (0, 8), (0, 8))
RECORD = sum(b - a for a, b in PLANES)


def _pack(*columns: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress."""
    planes = [np.ascontiguousarray(x.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)[:, a:b].T).tobytes() for x, (a, b) in zip(columns, PLANES, strict=True)]
    return b"".join(planes)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // RECORD
    planes = np.frombuffer(blob, np.uint8).reshape(RECORD, n)
    out, at = [], 0
    for a, b in PLANES:
        full = np.zeros((n, 8), np.uint8)
        full[:, a:b] = planes[at : at + b - a].T
        out.append(full.reshape(-1).view("<u8"))
        at += b - a
    return out[0], out[1], out[2].view(np.int64)


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task has whole buckets, sorted; buckets are handled one at a time."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("flags", pa.binary())])

    def solve(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        sizes = [len(b) // RECORD for b in blobs]
        h, c, ids = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        order = np.lexsort((ids, c, h))
        sh, sc, si = h[order], c[order], ids[order]
        new_h = np.ones(len(h), bool)
        new_h[1:] = sh[1:] != sh[:-1]
        new = new_h.copy()
        new[1:] |= sc[1:] != sc[:-1]
        group, pair = np.cumsum(new_h) - 1, np.cumsum(new) - 1
        least = si[new]  # of each content
        starts = np.flatnonzero(new_h[new])
        several = np.diff(np.append(starts, len(least))) > 1
        differ = np.minimum.reduceat(least, starts) < np.maximum.reduceat(least, starts)
        own = si == least[pair]
        flags = np.empty(len(h), np.uint8)
        flags[order] = np.where(~own, ALL, np.where((several & differ)[group], FIRST, NONE))
        cut = np.cumsum([0, *sizes])
        return record(schema, chunks, [bucket] * len(blobs), [flags[a:b].tobytes() for a, b in zip(cut, cut[1:])])  # noqa: B905

    now, chunks, blobs = None, [], []
    for batch in batches:
        for bucket, chunk, blob in zip(*(batch.column(n).to_pylist() for n in ("bucket", "chunk", "pairs")), strict=True):
            if bucket != now and blobs:
                yield solve(now, chunks, blobs)
                chunks, blobs = [], []
            now = bucket
            chunks.append(chunk)
            blobs.append(blob)
    if blobs:
        yield solve(now, chunks, blobs)


def sighted(chunks: DataFrame, symbols: Callable, length: int, k: int, text_bytes: int, per_run: float) -> DataFrame:
    """Flags of each chunk's distinct runs: chunk, found array<struct<bucket, flags>>; per_run: text bytes a run."""
    spark = chunks.sparkSession
    importable(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(text_bytes / per_run / BUCKET_RUNS) + 1)
    sent = map_arrow(chunks, lambda b: _send(b, symbols, length, k, buckets), "bucket int, chunk long, pairs binary")
    dealt = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    flags = map_arrow(dealt, _flag, "chunk long, bucket int, flags binary")
    return flags.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "flags"))).alias("found"))


def resolve(chunks: DataFrame, found: DataFrame, symbols: Callable, length: int, k: int, send: Callable[[Chunk, np.ndarray], list[tuple]]) -> DataFrame:
    """Covered intervals of each chunk (kind 0) and what send makes of the runs for the exact step (kind 1).

    Rows: kind int, chunk long, key long, payload binary. Intervals: int64 triples doc, start, end, in symbols.
    """
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("key", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("chunk", "ids", "ends", "text", "found")}
                chunk = Chunk(row["ids"], row["ends"], row["text"], symbols, length, k)
                flags = np.frombuffer(b"".join(f["flags"] for f in row["found"]), np.uint8)
                flag, own = flags[chunk.pair], chunk.ids[chunk.doc] == chunk.pair_id[chunk.pair]
                gone = (flag == ALL) | ~own
                cover = np.stack([chunk.doc[gone], chunk.start[gone], (chunk.start + chunk.count + length - 1)[gone]], 1).astype(np.int64)
                rows = [(0, row["chunk"], None, cover.tobytes())] if len(cover) else []
                rows += [(1, row["chunk"], key, payload) for key, payload in send(chunk, np.flatnonzero(own & (flag == FIRST)))]
                if rows:
                    yield record(schema, *map(list, zip(*rows, strict=True)))

    return map_arrow(by_chunk(chunks, found), run, "kind int, chunk long, key long, payload binary")


def by_chunk(chunks: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """chunks has its buckets already; only the other side moves."""
    return chunks.join(other.hint("shuffle_hash"), "chunk", how)


def merge(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, maximal intervals of (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def finish(chunks: DataFrame, covers: DataFrame, make: Callable[[bytes, np.ndarray], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """A row for each document: id, then make(text, merged intervals); covers: chunk, payload of int64 triples."""
    spans = covers.groupBy("chunk").agg(F.collect_list("payload").alias("payloads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                carried = row["rows"] or [None] * len(row["ids"])
                cover = np.frombuffer(b"".join(row["payloads"] or []), np.int64).reshape(-1, 3)
                cover = cover[np.argsort(cover[:, 0], kind="stable")]
                edges = np.searchsorted(cover[:, 0], np.arange(len(row["ids"]) + 1))
                rows, at = [], 0
                for d, (doc, end, other) in enumerate(zip(row["ids"], row["ends"], carried, strict=True)):
                    rows.append((doc, *make(row["text"][at:end], merge(cover[edges[d] : edges[d + 1], 1:])), *([other] if "row" in arrow.names else [])))
                    at = end
                yield record(arrow, *map(list, zip(*rows, strict=True)))

    return map_arrow(by_chunk(chunks, spans, "left"), run, schema)
