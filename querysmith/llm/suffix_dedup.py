"""Removal of repeated byte strings by suffix arrays of shards, built by induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import repeats
from .base import hot_join, map_arrow, record, release_all_but, scope, settle

#: Bytes of a repeated string and of the k-grams that minimisers are chosen from.
LENGTH, GRAM = 50, 20
#: Bytes of a shard whose suffixes are sorted at once, and beyond which the runs of one key are split by further bytes.
SHARD_BYTES, GROUP_BYTES = 4 << 20, 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def byte_values(text: bytes) -> np.ndarray:
    return repeats.BYTE_VALUES[np.frombuffer(text, np.uint8)]


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it (S-type). Zeros are separators, in text order."""
    s = np.ones(len(t), bool)
    step = np.flatnonzero((t[1:] != t[:-1]) | (t[1:] == 0))
    if len(step):
        at = np.searchsorted(step, np.arange(len(t) - 1))
        after = step[np.minimum(at, len(step) - 1)]
        s[:-1] = (t[after] < t[after + 1]) | (t[after] == 0)
    return s


def _spread(places: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    edges = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]])
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        into[chars[a]].append(places[a:b])


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the LMS suffixes in order.

    The scan goes bucket by bucket of the first byte; within one, the suffixes that its own suffixes induce
    are taken in waves, so each suffix is moved once and the work is linear.
    """
    size = 257
    empty = np.zeros(0, np.int64)
    joined = lambda parts: np.concatenate(parts) if parts else empty
    leftmost: list[list[np.ndarray]] = [[] for _ in range(size)]
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    _spread(lms, t[lms], leftmost)
    for c in range(size):
        wave, done = joined(large[c]), []
        while len(wave):
            done.append(wave)
            p = wave - 1
            p = p[(p >= 0) & ~s[p]]
            same = t[p] == c
            wave, rest = p[same], p[~same]
            if len(rest):
                _spread(rest, t[rest], large)
        large[c] = done
        p = joined(leftmost[c]) - 1
        p = p[p >= 0]
        if len(p):
            _spread(p, t[p], large)
    for c in range(size - 1, 0, -1):
        wave, done = joined(small[c]), []
        while len(wave):
            done.append(wave)
            p = wave - 1
            p = p[(p >= 0) & s[p] & (t[p] > 0)]
            same = t[p] == c
            wave, rest = p[same], p[~same]
            if len(rest):
                _spread(rest, t[rest], small)
        small[c] = done
        p = joined(large[c])[::-1] - 1
        p = p[(p >= 0) & s[p] & (t[p] > 0)]
        if len(p):
            _spread(p, t[p], small)
    out = [np.flatnonzero(t == 0)]
    for c in range(1, size):
        out += [*large[c], joined(small[c])[::-1]]
    return np.concatenate(out)


def rank_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of the string of names in order: names sort first, then pairs of ranks of doubled reach.

    The alphabet here is as large as the string, so buckets hold few suffixes; separators have names of
    their own, so no reach exceeds a run, and a few rounds give all suffixes ranks of their own.
    """
    rank, reach = names.astype(np.int64), 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:] + 1
        key = rank * (len(rank) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        if new.all() or reach >= len(rank):
            return order
        reach *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes + 1 with zeros as separators (each differs from all others, earlier ones are
    smaller; the last value has to be one): classify, sort LMS substrings, rank their names, induce."""
    s = classify(t)
    is_lms = s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s[:-1]
    text_order = np.flatnonzero(is_lms)
    if len(text_order) < 2:
        return induce(t, s, text_order)
    first = induce(t, s, text_order)
    lms = first[is_lms[first]]
    end = np.empty(len(t), np.int64)
    end[text_order] = np.append(text_order[1:], len(t) - 1)
    length = end[lms] - lms
    same = np.zeros(len(lms), bool)
    same[1:] = (length[1:] == length[:-1]) & (t[end[lms[1:]]] != 0) & (t[lms[1:]] != 0)
    left, off = np.flatnonzero(same), 0
    while len(left):
        a, b = lms[left], lms[left - 1]
        differ = t[a + off] != t[b + off]
        same[left[differ]] = False
        left = left[~differ]
        left = left[length[left] > off]
        off += 1
    names = np.empty(len(t), np.int64)
    names[lms] = np.cumsum(~same) - 1
    reduced = names[text_order]
    if same.any():
        lms = text_order[rank_names(reduced)]
    return induce(t, s, lms)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the text, whether its suffix shares length symbols with the one before it in order.

    This is the permuted common-prefix array, cut off at length; symbols compare in text order, in blocks.
    """
    before = np.full(len(t), -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([t, np.zeros(length, t.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)
    zeros = np.concatenate([[0], np.cumsum(padded == 0)])
    whole = zeros[length : length + len(t)] == zeros[: len(t)]
    out = np.zeros(len(t), bool)
    place = np.flatnonzero(whole & (before >= 0))
    for width in (8, length):  # most differ early
        place = np.concatenate([p[(windows[p, :width] == windows[before[p], :width]).all(1)] for p in np.array_split(place, len(place) // 50_000 + 1)])
    out[place] = True
    return out


def shard_repeats(texts: list[bytes], ids: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of each stretch covered by strings that a text with a smaller id has too."""
    joined = b"\x00".join(texts) + b"\x00"
    t = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(x) + 1 for x in texts])
    t[ends - 1] = 0
    order = suffix_array(t)
    shared = permuted_prefixes(t, order, length)[order]
    group = np.cumsum(~shared) - 1
    owner = np.searchsorted(ends, order, side="right")
    own = ids[owner]
    least = np.minimum.reduceat(own, np.flatnonzero(~shared))
    hit = np.sort(order[own > least[group]])
    if not len(hit):
        return []
    of = np.searchsorted(ends, hit, side="right")
    start = hit - np.concatenate([[0], ends[:-1]])[of]
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[1:] != of[:-1])])
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)
    return list(zip(of[first].tolist(), start[first].tolist(), (start[last] + length).tolist(), strict=True))


def _send(length: int):
    def send(chunk: repeats.Chunk, runs: np.ndarray) -> list[tuple]:
        rows = []
        for r in runs:
            d, s, n = int(chunk.doc[r]), int(chunk.start[r]), int(chunk.count[r])
            head = np.array([chunk.ids[d], d, s], np.int64).tobytes()
            rows.append((int(chunk.h[r] >> np.uint64(1)), head + chunk.texts[d][s : s + n + length - 1]))
        return rows

    return send


def _sorted_shards(length: int):
    """Rows come by minimiser; a shard ends between two of them. A group above the bound never comes here."""

    def solve(chunks: list[int], payloads: list[bytes]) -> pa.RecordBatch | None:
        heads = np.frombuffer(b"".join(p[:24] for p in payloads), np.int64).reshape(-1, 3)
        found = shard_repeats([p[24:] for p in payloads], heads[:, 0], length)
        rows = [(chunks[i], np.array([heads[i, 1], heads[i, 2] + a, heads[i, 2] + b], np.int64).tobytes()) for i, a, b in found]
        return record(pa.schema([("chunk", pa.int64()), ("payload", pa.binary())]), *map(list, zip(*rows, strict=True))) if rows else None

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, chunks, payloads = None, 0, [], []
        for batch in batches:
            for chunk, key, payload in zip(*(batch.column(n).to_pylist() for n in ("chunk", "key", "payload")), strict=True):
                if held > SHARD_BYTES and key != last:
                    if (out := solve(chunks, payloads)) is not None:
                        yield out
                    held, chunks, payloads = 0, [], []
                chunks.append(chunk)
                payloads.append(payload)
                held += len(payload)
                last = key
        if payloads and (out := solve(chunks, payloads)) is not None:
            yield out

    return shards


def _split(length: int, gram: int, level: int):
    """Runs of one key as shorter runs with longer keys, for equal strings that still have equal keys.

    A string's minimiser lies at some offset of it; offsets are cut into 2 ** level ranges, and all strings
    whose offset is in one range share length - width + 1 bytes around the minimiser (width: offsets of a
    range). Those bytes are the new key. With a single offset in a range the key is the whole string.
    """
    width = max(1, -(-(length - gram + 1) >> level))
    seed = np.uint64((level * 2 + 1) * repeats.BASE % (1 << 64))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            rows = []
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                doc, d, s = np.frombuffer(payload[:24], np.int64).tolist()
                text = payload[24:]
                values = byte_values(text)
                prefix = repeats.prefix_hash(values)
                grams = repeats.window_hashes(prefix, gram)
                offset = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(1)
                at = np.arange(len(offset)) + offset  # of the minimiser
                part = offset // width
                edges = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1])) + 1, [len(at)]])
                shared = repeats.window_hashes(prefix, length - width + 1)
                first = at[edges[:-1]] - part[edges[:-1]] * width
                keys = repeats.mix(shared[first] ^ seed ^ part[edges[:-1]].astype(np.uint64)) >> np.uint64(1)
                for a, b, key in zip(edges[:-1].tolist(), edges[1:].tolist(), keys.tolist(), strict=True):
                    rows.append((chunk, key, np.array([doc, d, s + a], np.int64).tobytes() + text[a : b + length - 1]))
            if rows:
                yield record(schema, *map(list, zip(*rows, strict=True)))

    return convert


def _levels(length: int, gram: int) -> int:
    """Splits after which a key is a whole string."""
    return (length - gram).bit_length()


def _same_strings(runs: DataFrame, length: int) -> DataFrame:
    """Covers of runs whose key is their whole string: all but those of the least document are covered."""
    named = map_arrow(runs, _heads, "chunk long, key long, doc long, d long, s long")
    named = settle(named)
    least = named.groupBy("key").agg(F.min("doc").alias("least"))
    again = hot_join(named, least, "key", named.count()).filter("doc > least").select("chunk", "d", "s")

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, s = batch.column("d").to_numpy(), batch.column("s").to_numpy()
            spans = np.stack([d, s, s + length], 1).astype(np.int64)
            yield record(pa.schema([("chunk", pa.int64()), ("payload", pa.binary())]), batch.column("chunk"), [x.tobytes() for x in spans])

    return map_arrow(again, covers, "chunk long, payload binary")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("chunk", "key", "doc", "d", "s")])
    for batch in batches:
        head = np.frombuffer(b"".join(p[:24] for p in batch.column("payload").to_pylist()), np.int64).reshape(-1, 3)
        yield record(schema, batch.column("chunk"), batch.column("key"), *(pa.array(np.ascontiguousarray(head[:, i])) for i in range(3)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Remove each byte covered by a string of length bytes that also starts in a document with a smaller id.

    Runs of strings with one minimiser and equal content are settled by their content (see repeats). The
    distinct contents of all other runs go, by minimiser, to shards of a few MB; each shard's suffix array
    is induced, and suffixes that follow each other with common prefixes of length bytes are the equal
    strings. Runs of a minimiser with more than GROUP_BYTES are split by further bytes, again and again, until
    a key's runs fit in a shard or the key is a whole string, whose least document is all there is to find.

    A null text is empty; texts shorter than length are kept; a null id counts as larger than all others;
    rows with equal ids don't remove from each other; an empty table gives no rows; other columns are
    ignored. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; or, with
    rewrite, the rows of docs with the remaining text (bytes of a character that was cut are dropped).
    """
    chunks = repeats.store(docs, id_col, text_col, rewrite)
    with scope() as made:
        covers = settle(_covers(chunks, docs, length, gram, group_bytes))
    release_all_but(made, covers)

    def make(text: bytes, spans: np.ndarray) -> tuple:
        kept, at = [], 0
        for a, b in spans.tolist():
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        joined = b"".join(kept)
        out = (len(text), len(text) - len(joined), len(spans), hashlib.sha256(joined).hexdigest())
        return (*out, joined.decode(errors="ignore")) if rewrite else out

    fields = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())]
    if not rewrite:
        return repeats.finish(chunks, covers, make, RESULT, pa.schema(fields))
    done = repeats.finish(chunks, covers, make, f"{RESULT}, kept string, row string", pa.schema([*fields, ("kept", pa.string()), ("row", pa.string())]))
    other = StructType([f for f in docs.schema.fields if f.name != text_col])
    full = done.select("kept", F.from_json("row", other).alias("row"))
    return full.select(*(F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def _covers(chunks: DataFrame, docs: DataFrame, length: int, gram: int, group_bytes: int) -> DataFrame:
    """Covered intervals (chunk, payload) of all documents."""
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeats.sighted(chunks, byte_values, length, gram, size, (length - gram + 2) / 2)
    parts = settle(repeats.resolve(chunks, found, byte_values, length, gram, _send(length)))
    exact = parts.filter("kind = 1").select("chunk", "key", "payload")
    covers = parts.filter("kind = 0").select("chunk", "payload")
    least_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(1, _levels(length, gram) + 2):
        big = settle(exact.groupBy("key").agg(F.sum(F.length("payload")).alias("size")).filter(F.col("size") > group_bytes).select("key"))
        done = big.isEmpty()
        light = exact if done else exact.join(big, "key", "left_anti")
        total = light.agg(F.sum(F.length("payload"))).first()[0] or 0
        sharded = light.repartition(max(least_tasks, total // (2 * SHARD_BYTES)), "key").sortWithinPartitions("key")
        covers = covers.unionByName(map_arrow(sharded, _sorted_shards(length), "chunk long, payload binary"))
        if done:
            break
        heavy = exact.join(big, "key", "left_semi").select("chunk", "key", "payload")
        if level > _levels(length, gram):
            covers = covers.unionByName(_same_strings(heavy, length))
            break
        exact = settle(map_arrow(heavy, _split(length, gram, level), "chunk long, key long, payload binary"))
    return covers
