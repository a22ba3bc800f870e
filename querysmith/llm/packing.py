"""Shortest-pack-first packing of token sequences over their length histogram."""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import weakref
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import bucket_count, ranked
from .base import column, hash60, map_arrow, record, settle, slices

#: Entries that a cache of words may hold in a worker, and the longest key that is kept: with keys of at most 64
#: characters, an entry takes about 220 bytes and 700 at most, which bounds a cache's bytes.
CACHE, LONGEST = 1_000_000, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: How the tokenizer file splits a normalised text (fixed value of that file).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level tokenizers show a printable byte as its Latin-1 character, the others from U+0100 on.
_shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_shown))}


_caches: list[weakref.ref] = []


def only(*kept: dict) -> None:
    """Empty all other caches of this worker, which an earlier operator may have filled."""
    for ref in _caches:
        cache = ref()
        if cache is not None and not any(cache is k for k in kept):
            cache.clear()


class Cached(dict):
    """A dict that makes missing values by a function, and forgets its older half when it is full.

    Keys longer than LONGEST (texts without spaces) are never kept, so entries and bytes are bounded.
    """

    def __init__(self, make: Callable, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most
        _caches.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.make(key)
        return value if isinstance(key, bytes | str) and len(key) > LONGEST else self.put(key, value)

    def put(self, key, value):
        if len(self) >= self.most:
            newer = list(self.items())[self.most // 2 :]
            self.clear()
            self.update(newer)
        self[key] = value
        return value


class WordTokenizer:
    """Ids of a tokenizer file whose pieces never cross white space, word by word through caches.

    Texts in which a special token's string or an information separator occurs (the only cases in which
    splitting at white space could differ) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        self.model = self.tok.model
        self.plain = re.compile("[\x00-\u024f]+").fullmatch
        self.split = regex.compile(PIECE).findall
        self.words = Cached(self._word)
        self.pieces = Cached(self._piece, CACHE // 2)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin1").translate(BYTE_CHARS)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Words of Latin letters that are composed already: lower-cased and split here, else by the library."""
        if word.isascii() or self.plain(word) and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            return self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.split(low)))
        return self._encode(word)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        for odd in self.odd:
            if odd in text:
                return self._encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
    only(tok.words, tok.pieces)
    kind = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    for batch in slices(batches, text_col):
        rows: list[tuple] = []
        for doc, text in zip(column(batch, id_col), column(batch, text_col), strict=True):
            ids = tok(text or "") + end
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
        yield record(kind, *map(list, zip(*rows, strict=True)))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Pattern counts (count, lengths) that hold every length as often as the histogram has it.

    Lengths go longest first, each into the pack that is shortest at that time and has room; all packs of
    one pattern take the length together, and a pattern is split where fewer pieces are left than packs.
    Work follows the number of distinct lengths, not of pieces.
    """
    done: list[tuple[int, list[int]]] = []
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by filled length
    filled: list[int] = []
    least = min(histogram, default=0)

    def put(length: int, count: int, pattern: list[int]) -> None:
        if length + least > capacity:
            done.append((count, pattern))
            return
        if length not in open_:
            bisect.insort(filled, length)
            open_[length] = []
        open_[length].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if filled and filled[0] + length <= capacity:
                at = filled[0]
                count, pattern = open_[at].pop()
                if not open_[at]:
                    del open_[at]
                    filled.pop(0)
                taken = min(left, count)
                if taken < count:
                    put(at, count - taken, pattern)
                put(at + length, taken, [*pattern, length])
                left -= taken
            else:
                # New packs: as many as the rest of this length needs when packs fill with it alone.
                each = max(1, capacity // length)
                full, rest = divmod(left, each)
                if full:
                    put(each * length, full, [length] * each)
                if rest:
                    put(rest * length, 1, [length] * rest)
                left = 0
    return done + [x for group in open_.values() for x in group]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of all texts (each followed by end_id) into sequences of at most capacity ids.

    A document longer than capacity is cut into full pieces and one rest. The histogram of piece lengths
    (at most capacity entries) goes to the driver, where patterns are packed shortest pack first; pieces
    then meet their place by (length, rank among the pieces of that length). The rank is taken in hash
    buckets, so that one very common length doesn't meet in one task. Rows of the placement table are
    bounded by capacity and the number of patterns, not by the input.

    A null text is an empty one, which is a piece with end_id alone; null ids are kept; repeated rows are
    pieces of their own; an empty table gives no rows; other columns are ignored.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    pieces = settle(map_arrow(narrow, lambda b: cut(b, tokenizer_path, capacity, end_id, id_col, text_col), PIECES).withColumn("__h", hash60(F.col("doc_id"), F.col("start"), F.col("ids_crc32"))))
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    places, sequence = [], 0
    for count, pattern in shortest_pack_first(histogram, capacity):
        offset = i = 0
        while i < len(pattern):
            length = pattern[i]
            run = 1
            while i + run < len(pattern) and pattern[i + run] == length:
                run += 1
            # Pieces ranked used+1 .. used+run*count fill this run of equal slots, sequence after sequence.
            places.append((length, used[length] + 1, used[length] + run * count, run, sequence, offset))
            used[length] += run * count
            offset += run * length
            i += run
        sequence += count
    plan = spark.createDataFrame(places, "p_length long, first long, last long, run long, sequence long, base long")
    # One bucket of ranks for each run of places keeps the join an equi-join on the length with few matches.
    total = sum(histogram.values())
    buckets = bucket_count(total)
    ranked_pieces = ranked(pieces, ["length"], F.floor(F.col("__h") / F.lit((1 << 60) // buckets)), [F.col("__h"), F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")], "rank", "n")
    lists = plan.groupBy("p_length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "run", "sequence", "base"))).alias("places"))
    placed = ranked_pieces.join(F.broadcast(lists), F.col("length") == F.col("p_length"))
    hit = F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") <= p["last"]))[0]
    at = placed.withColumn("p", hit).withColumn("k", F.col("rank") - F.col("p.first"))
    return at.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p.sequence") + F.expr("k div p.run")).alias("sequence_id"),
        (F.col("p.base") + (F.col("k") % F.col("p.run")) * F.col("length")).alias("offset"),
    )
