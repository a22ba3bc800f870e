"""Removal of repeated token windows: Rabin-Karp hashes of every window, counted over Spark's partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .base import map_arrow, record
from .packing import only

#: Words of a window; window records that a partition of hashes aims to hold.
WINDOW, BUCKET_WINDOWS = 50, 400_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
RECORD = 20  # eight bytes of the first hash, four of the second, eight of the id


class Windows:
    """All windows of a chunk's documents, and one record for each distinct one: its hashes and its least id.

    The chunk's words are one array; windows that reach over the end of a document are left out.
    """

    def __init__(self, ids: list, ends: list, text: bytes, window: int):
        self.ids = np.array([repeats.LAST if i is None else i for i in ids], np.int64)
        values, counts = repeats.word_hashes(text, ends)
        place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        doc = np.repeat(np.arange(len(ids)), counts)
        whole = np.flatnonzero(place <= counts[doc] - window)
        self.doc, self.at = doc[whole], place[whole]
        h = repeats.window_hashes(repeats.prefix_hash(values), window)[whole] if len(values) >= window else np.zeros(0, np.uint64)
        g = second_hashes(values, window)[whole] if len(values) >= window else np.zeros(0, np.uint32)
        order = np.argsort(h)
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.record = np.empty(len(h), np.int64)
        self.record[order] = np.cumsum(new) - 1
        self.h, self.g = h[new], g[new]
        self.id = np.minimum.reduceat(self.ids[self.doc[order]], np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)


def second_hashes(values: np.ndarray, window: int) -> np.ndarray:
    """32 bits of the Rabin-Karp hashes of other word values, the same words with their halves exchanged."""
    prefix = repeats.prefix_hash((values >> np.uint64(32)) | (values << np.uint64(32)))
    n = len(prefix) - window
    return ((prefix[window:] - prefix[:n]) * repeats.powers(n)[1] >> np.uint64(32)).astype(np.uint32)


def pack(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> bytes:
    """Records by byte planes, sorted hashes as differences: high bytes hardly change, so they compress."""
    steps = np.diff(h.astype("<u8"), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (steps, g.astype("<u4"), ids.astype("<i8"))]
    return b"".join(planes)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(RECORD, -1)
    h, g, ids = (np.ascontiguousarray(planes[a:b].T).reshape(-1) for a, b in ((0, 8), (8, 12), (12, 20)))
    return np.cumsum(h.view("<u8"), dtype=np.uint64), g.view("<u4"), ids.view("<i8")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _send(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct windows, by hash; a bucket's records are a stretch of them."""
    only()
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("records", pa.binary())])
    for row in _rows(batches):
        w = Windows(row["ids"], row["ends"], row["text"], window)
        if not len(w.h):
            continue
        at = repeats.bucket_of(w.h, buckets)
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        packed = [pack(w.h[a:b], w.g[a:b], w.id[a:b]) for a, b in zip(edges, edges[1:])]  # noqa: B905
        yield record(schema, at[edges[:-1]].tolist(), [row["chunk"]] * len(packed), packed)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each record of a bucket a bit: whether a smaller document has its window. Rows come by bucket."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("again", pa.binary())])

    def solve(bucket: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        h, g, ids = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
        order = np.argsort(h)
        sh = h[order]
        met = np.zeros(len(h), bool)  # part of a group of equal first hashes
        met[1:] = sh[1:] == sh[:-1]
        met[:-1] |= met[1:]
        again = np.zeros(len(h), bool)
        places = order[met]
        if len(places):
            places = places[np.lexsort((ids[places], g[places], h[places]))]
            new = np.ones(len(places), bool)
            new[1:] = (h[places[1:]] != h[places[:-1]]) | (g[places[1:]] != g[places[:-1]])
            least = ids[places[new]][np.cumsum(new) - 1]
            again[places] = ids[places] > least
        sizes = [len(b) // RECORD for b in blobs]
        cut = np.cumsum([0, *sizes])
        return record(schema, chunks, [bucket] * len(blobs), sizes, [np.packbits(again[a:b]).tobytes() for a, b in zip(cut, cut[1:])])  # noqa: B905

    now, chunks, blobs = None, [], []
    for batch in batches:
        for bucket, chunk, blob in zip(*(batch.column(n).to_pylist() for n in ("bucket", "chunk", "records")), strict=True):
            if bucket != now and blobs:
                yield solve(now, chunks, blobs)
                chunks, blobs = [], []
            now = bucket
            chunks.append(chunk)
            blobs.append(blob)
    if blobs:
        yield solve(now, chunks, blobs)


def _finish(batches: Iterator[pa.RecordBatch], window: int, texts: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Covered words of each document of a chunk, removed."""
    only()
    for row in _rows(batches):
        w = Windows(row["ids"], row["ends"], row["text"], window)
        bits = [np.unpackbits(np.frombuffer(f["again"], np.uint8), count=f["n"]) for f in row["found"] or []]
        again = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        # A window is met again where another task has a smaller id, or where this chunk has one.
        gone = again[w.record] | (w.ids[w.doc] > w.id[w.record]) if len(w.record) else np.zeros(0, bool)
        doc, at = w.doc[gone], w.at[gone]
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        edges = np.searchsorted(doc, np.arange(len(row["ids"]) + 1))
        rows, start = [], 0
        for d, (i, end) in enumerate(zip(row["ids"], row["ends"], strict=True)):
            mine = at[edges[d] : edges[d + 1]]
            rows.append((i, *_kept(row["text"][start:end], repeats.merge(np.stack([mine, mine + window], 1)), texts)))
            start = end
        yield record(arrow, *map(list, zip(*rows, strict=True)))


def _kept(text: bytes, spans: np.ndarray, texts: bool) -> tuple:
    words = text.split()
    kept, at = [], 0
    for a, b in spans.tolist():
        kept += words[at:a]
        at = b
    kept += words[at:]
    joined = b" ".join(kept)
    out = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest())
    return (*out, joined.decode()) if texts else out


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller id.

    Every window is hashed twice (Rabin-Karp, 96 bits together). A chunk of documents sends each distinct
    window once, with its least id, to the partition of its hash; there the records of equal windows are
    counted and compared with the least id of all. A window that is in every document is one record a chunk.
    One bit a record goes back to its chunk, where overlapping and touching windows merge.

    A null text has no words; texts shorter than a window keep all; a null id counts as larger than all
    others; rows with equal ids don't remove from each other; an empty table gives no rows; other columns
    are ignored. Returns doc_id, n_words, n_removed, kept_sha256, and kept (the text) where texts is set.
    """
    chunks = repeats.store(docs, id_col, text_col)
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size / 6.0 / BUCKET_WINDOWS) + 1)
    sent = map_arrow(chunks.select("chunk", "ids", "ends", "text"), lambda b: _send(b, window, buckets), "bucket int, chunk long, records binary")
    dealt = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    flags = map_arrow(dealt, _count, "chunk long, bucket int, n int, again binary")
    found = flags.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "again"))).alias("found"))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if texts else [])])
    joined = repeats.by_chunk(chunks.select("chunk", "ids", "ends", "text"), found, "left")
    return map_arrow(joined, lambda b: _finish(b, window, texts, arrow), RESULT + (", kept string" if texts else ""))
