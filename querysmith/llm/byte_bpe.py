"""Byte-level BPE as a monoid: halves are encoded and joined by re-encoding growing boundary windows."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_arrow, record, slices
from .packing import CACHE, Cached

#: Bytes of a leaf of the encoding tree (and parts of one of the decoding tree), tokens of the first boundary window on each side.
LEAF, WINDOW = 16, 2
#: White space as the rank files' library understands it (fixed values of the Unicode property).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def joined(parts: list[bytes]) -> bytes:
    """Concatenation up a tree: leaves of LEAF parts, then neighbours are joined, then neighbours of those, until one is left."""
    parts = [b"".join(parts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else []
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + odd  # noqa: B905  an odd last one is added
    return parts[0] if parts else b""


class ByteBPE:
    """Encoder and decoder of one rank file.

    A sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is the encoding
    of the pair's bytes, as merges are applied by rank and every token is made by its own merges. So a
    joined sequence is proven by the pairs at the edges of the window that was encoded anew.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.none = len(self.ranks) + max(self.bytes_of)
        ours = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")
        self.pattern = regex.compile(ours)
        self.pairs = Cached(lambda p: self.merge(self.bytes_of[p[0]] + self.bytes_of[p[1]]) == [*p])
        self.words = Cached(lambda w: array("I", self.encode(w.encode())))
        self.chunks = Cached(self._chunk, CACHE * 2 // 3)

    def merge(self, data: bytes) -> list[int]:
        """Apply the merges by rank, leftmost first, on a few bytes."""
        rank, none = self.ranks, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905  one shorter
        while costs and (best := min(costs)) != none:
            i = costs.index(best)
            made = parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank.get(parts[i - 1] + made[0], none)
            if i < len(costs):
                costs[i] = rank.get(made[0] + parts[i + 1], none)
        return [rank[p] for p in parts]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pattern match: the whole if it is a token, else its halves joined."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sequences' bytes together; either may be empty."""
        if not left or not right or self.pairs[left[-1], right[0]]:
            return left + right
        i = j = WINDOW
        while True:
            keep, rest = left[: max(0, len(left) - i)], right[j:]
            window = b"".join(map(self.bytes_of.__getitem__, left[len(keep) :] + right[:j]))
            middle = self.merge(window)
            good_left = not keep or self.pairs[keep[-1], middle[0]]
            good_right = not rest or self.pairs[middle[-1], rest[0]]
            if good_left and good_right:
                return keep + middle + rest
            i, j = i if good_left else 2 * i, j if good_right else 2 * j

    def decode(self, ids) -> bytes:
        """The bytes of the ids: halves are decoded and joined, up to the whole."""
        return joined([self.bytes_of[i] for i in ids])

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        ids = list(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(chunk))))
        return " ".join(map(str, ids)), self.decode(ids)

    def ids(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0].split()]

    def parts(self, text: str) -> list[tuple[str, bytes]]:
        """Cached encodings (listed ids and the bytes they decode to) whose concatenation is the text's.

        A match can't reach across a space that has anything but white space on one side, so texts are cut
        before their spaces; a text with a space between white space goes through the pattern whole.
        """
        if "  " in text or any(w + " " in text for w in SPACE if w != " "):
            return [self._chunk(text)]
        first, *rest = text.split(" ")
        got = self.chunks
        return ([got[first]] if first else []) + [got[" " + x] for x in rest]


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path, pattern)
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    for batch in slices(batches, text_col):
        n, ids_sha, text_sha = [], [], []
        for text in column(batch, text_col):
            lists, data = zip(*parts, strict=True) if (parts := bpe.parts(text or "")) else ((), ())
            listed = " ".join(lists).encode()
            n.append(listed.count(b" ") + 1 if listed else 0)
            ids_sha.append(hashlib.sha256(listed).hexdigest())
            text_sha.append(hashlib.sha256(joined(data)).hexdigest())
        yield record(kind, batch.column(id_col).cast(pa.int64()), n, ids_sha, text_sha)


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as an array (null text: empty array)."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    def run(batches):
        bpe = coder(path, pattern)
        for batch in slices(batches, text_col):
            ids = [bpe.ids(t or "") for t in column(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again; digests of both.

    One pass, no shuffle; a worker's memory is bounded by a slice of texts and by its caches, which start
    anew when full. A null text is empty (no tokens); null ids are kept; repeated rows give repeated rows;
    an empty table gives no rows; other columns are ignored.
    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return map_arrow(narrow, lambda b: digests(b, path, pattern, id_col, text_col), ENCODED)
