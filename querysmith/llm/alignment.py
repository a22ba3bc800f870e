"""Cross-tokenizer alignment: a dangling-suffix transducer over two token sequences, and counts of their links."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .base import column, map_arrow, record, settle, slices
from .packing import BYTE_CHARS, LONGEST, Cached, only

#: Characters of text whose documents share one list of distinct links, words whose alignment a worker keeps, and
#: words that go to the tokenizers together.
CHUNK, WORDS_KEPT, LOT = 8 << 20, 400_000, 4096
#: Bytes of text that are cut into words at once.
SLICE = 2 << 20
#: A space between two characters that no Unicode definition calls white space: both tokenizers start a token there.
CUT = re.compile(r"(?<=\S) (?=\S)")

#: A state of the transducer: leading side, its unmatched bytes.
State = tuple[int, bytes]
#: Tokens of side A, groups as text, packed links (A id in the upper, B id in the lower 32 bits); None: bytes differ.
Word = tuple[int, str, bytes] | None


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file."""
    byte = {c: b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARS}
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    entries = known["model"]["vocab"] | {t["content"]: t["id"] for t in known["added_tokens"]}
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def piece_vocabulary(model) -> list[bytes]:
    """Bytes of each id of a piece model: U+2581 is a space, a byte piece its byte."""
    show = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return [show(i) for i in range(model.get_piece_size())]


class Transducer:
    """Aligns two token sequences of the same bytes.

    The state is which side leads and the bytes of its last token that the other side hasn't matched yet. The
    next token always comes from the side behind; what it does to a state is memoised by (state, token). Each
    such token overlaps exactly the leading token, which is a link; an empty residual closes a group. States are
    numbered; their residuals are ends of tokens, so the vocabularies bound them.
    """

    def __init__(self, *sides: list[bytes]):
        self.sides = sides
        self.states: list[State] = [(0, b"")]
        self.numbers: dict[State, int] = {}
        self.moves = Cached(self._move)

    def state(self, lead: int, residual: bytes) -> int:
        """Twice the number of a state, plus its side; 0 for no residual."""
        if not residual:
            return 0
        if (lead, residual) not in self.numbers:
            self.numbers[lead, residual] = 2 * len(self.states) + lead
            self.states.append((lead, residual))
        return self.numbers[lead, residual]

    def _move(self, key: int) -> int:
        """The next state; -1 where bytes differ. From the empty state, a token of A leads."""
        (lead, residual), token = self.states[key >> 33], key & 0xFFFFFFFF
        if not residual:
            return self.state(0, self.sides[0][token])
        data = self.sides[1 - lead][token]
        if len(data) <= len(residual):
            return self.state(lead, residual[len(data) :]) if residual.startswith(data) else -1
        return self.state(1 - lead, data[len(residual) :]) if data.startswith(residual) else -1

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]] | None:
        """Groups (ids of A, ids of B) and links in order; None if the sequences' bytes differ."""
        more_a, more_b, moves = iter(a), iter(b), self.moves
        groups, links = [], []
        for first in more_a:
            state, last, xs, ys = moves[first], first, [first], []
            while state:
                if state & 1:
                    if (token := next(more_a, -1)) < 0 or (new := moves[state << 32 | token]) < 0:
                        return None
                    xs.append(token)
                    links.append(token << 32 | last)
                    if not new & 1:
                        last = token
                else:
                    if (token := next(more_b, -1)) < 0 or (new := moves[state << 32 | token]) < 0:
                        return None
                    ys.append(token)
                    links.append(last << 32 | token)
                    if new & 1:
                        last = token
                state = new
            groups.append((xs, ys))
        return (groups, links) if next(more_b, None) is None else None


def shown(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join([f"{a[0]}|{b[0]}" if len(a) == len(b) == 1 else f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups])


class Aligner:
    """Tokenizes texts by both files and aligns them, word by word through a cache.

    Texts are cut where both tokenizers start a token whatever stands around: before a space between two
    characters that aren't white space (no piece of B holds a space behind another character, which is
    checked). There the transducer is always between two groups, so words align on their own.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.sides = byte_level_vocabulary(a_path), piece_vocabulary(self.b)
        self.machine = Transducer(*self.sides)
        self.cut = all(b" " not in piece.lstrip(b" ") for piece in self.sides[1])
        self.words: Cached = Cached(lambda w: dict(self._batch([w]))[w], WORDS_KEPT)

    def parts(self, text: str) -> list[str]:
        return CUT.split(text) if self.cut else [text]

    def _batch(self, words: list[str]) -> Iterator[tuple[str, Word]]:
        left = self.sides[0]
        for i in range(0, len(words), LOT):
            lot = words[i : i + LOT]
            a = self.a.encode_batch_fast([" " + w for w in lot], add_special_tokens=False)
            for word, x, ys in zip(lot, a, self.b.encode(lot, num_threads=1), strict=True):
                xs = x.ids
                found = self.machine.align(xs, ys) if b"".join([left[t] for t in xs]) == b" " + word.encode() else None
                yield word, (len(xs), shown(found[0]), array("q", found[1]).tobytes()) if found else None

    def __call__(self, texts: list[str | None]) -> list[list[Word]]:
        """The alignment of each space+text in parts; no part for a text without tokens. Words that no text before
        had are tokenized together; those of these texts stay at hand whatever the cache forgets."""
        parts = [self.parts(t) if t else [] for t in texts]
        here: dict[str, Word] = dict.fromkeys(chain.from_iterable(parts))
        new = []
        for w in here:
            if w in self.words:
                here[w] = self.words[w]
            else:
                new.append(w)
        for word, value in self._batch(new) if new else ():
            here[word] = value
            if len(word) <= LONGEST:
                self.words.put(word, value)
        return [[] if None in got else got for got in ([here[w] for w in words] for words in parts)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
        gc.freeze()  # the vocabularies stay; looking them over again and again takes a tenth of a task's time
    return _aligners[a_path, b_path]


_DOCS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, held array<int>"
_KIND = pa.schema(
    [(n, pa.int64()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))]
)


def _documents(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with places of its distinct links in its chunk's list and how often it has them;
    a row for each chunk with that list (pairs) and in how many of its documents each pair is (held)."""
    own = aligner(a_path, b_path)
    only(own.words, own.machine.moves)
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 24
    rows: list[tuple] = []
    sets: list[np.ndarray] = []
    held = 0

    def done() -> Iterator[pa.RecordBatch]:
        pairs, place, count = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True, return_counts=True)
        place, at, places = place.astype("<u4"), 0, []
        for s in sets:
            places.append(np.diff(place[at : at + len(s)], prepend=np.uint32(0)).astype("<u4").tobytes())
            at += len(s)
        for i in range(0, len(rows), 2048):
            few = rows[i : i + 2048]
            cols = [*map(list, zip(*few, strict=True))]
            yield record(_KIND, [chunk] * len(few), *cols[:6], places[i : i + 2048], cols[6], [None] * len(few), [None] * len(few))
        if len(pairs):
            yield record(_KIND, [chunk], *[[None]] * 8, pa.ListArray.from_arrays([0, len(pairs)], pa.array(pairs)), pa.ListArray.from_arrays([0, len(count)], pa.array(count.astype(np.int32))))

    for batch in slices(batches, size=SLICE):
        texts = column(batch, "text")
        for doc, text, words in zip(column(batch, "doc_id"), texts, own(texts), strict=True):
            sizes, listed, packed = zip(*words, strict=True) if words else ((), (), ())
            links, joined = np.frombuffer(b"".join(packed), "<i8"), ";".join(listed)
            pairs, times = np.unique(links, return_counts=True)
            groups = joined.count(";") + 1 if words else 0
            n_a = sum(sizes)
            rows.append((doc, n_a, len(links) + groups - n_a, groups, len(links), hashlib.sha256(joined.encode()).hexdigest() if words else "", times.astype("<u4").tobytes()))
            sets.append(pairs)
            held += len(text or "")
            if held >= chunk_bytes:
                yield from done()
                rows, sets, held, chunk = [], [], 0, chunk + 1
    if rows:
        yield from done()


_COUNTED = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _counted(docs: pa.Table, links: pa.Table, best: np.ndarray) -> pa.Table:
    """Counts of the chunk's pairs, brought to its documents."""
    pairs, counts = links["pair"].to_numpy(), links["n_docs"].to_numpy()
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    top = counts == best[pairs >> 32] if len(pairs) else counts
    n_best, total = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, k = np.cumsum(np.frombuffer(places, "<u4"), dtype=np.int64), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(k[top[at]].sum()) if len(at) else 0)
        total.append(int((k * counts[at]).sum()) if len(at) else 0)
    return pa.table([*(docs[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), docs["groups_sha256"]], schema=_COUNTED)


def _linked(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents by chunk, and (chunk, pair, n_docs) for each chunk's distinct pairs with the corpus-wide count."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = settle(map_arrow(narrow, lambda b: _documents(b, a_path, b_path, chunk_bytes), _DOCS))
    spread = found.filter("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    # A pair has one row a chunk, a chunk has a row for each of its pairs: no key holds more than a chunk's share.
    everywhere = spread.selectExpr("chunk", "pair", "sum(CAST(held AS LONG)) OVER (PARTITION BY pair) AS n_docs")
    return found.filter("pairs IS NULL").drop("pairs", "held"), settle(everywhere)


def link_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """The mapping that the corpus shows: a_id, b_id, n_docs (documents that hold the pair linked), best (n_docs is
    the highest of a_id, ties included). Odd texts as for align."""
    _, links = _linked(docs, a_path, b_path, id_col, text_col, chunk_bytes)
    pairs = links.groupBy("pair").agg(F.first("n_docs").alias("n_docs")).selectExpr("CAST(shiftright(pair, 32) AS INT) AS a_id", "CAST(pair & 4294967295 AS INT) AS b_id", "n_docs")
    top = pairs.groupBy("a_id").agg(F.max("n_docs").alias("most"))  # one row for each id of A's vocabulary at most
    return pairs.join(F.broadcast(top), "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """Align each whole text's tokens by two tokenizers: byte-level A on space+text, pieces B on the text.

    Words align through the memoised transducer. The documents of a chunk (chunk_bytes characters of text, one document at
    least) share a list of distinct links; those lists are summed by pair in Spark, and counts go back to
    their chunk, so what moves is a row for each distinct pair of a chunk, whatever the number of its
    occurrences. Only the highest count of each A id (bounded by A's vocabulary) reaches all tasks. A worker
    holds one chunk's links, bounded by its bytes, or by one longer document.

    Texts that are null, empty, or differ from the bytes of either side's tokens (a text with U+2581 itself)
    have no tokens: zeros and an empty groups_sha256. Null ids are kept; repeated rows are documents of their
    own; an empty table gives no rows; other columns are ignored.
    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    """
    found, links = _linked(docs, a_path, b_path, id_col, text_col, chunk_bytes)
    size = len(byte_level_vocabulary(a_path))
    best = np.zeros(size, np.int64)
    for a, most in links.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs")).collect():
        best[a] = most
    importable(docs.sparkSession)
    return found.groupBy("chunk").cogroup(links.groupBy("chunk")).applyInArrow(lambda x, y: _counted(x, y, best), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the groups of each text in order: arrays of A and B ids, first byte and end in space+text."""
    importable(docs.sparkSession)
    group = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in slices(batches, size=SLICE):
            out = []
            for words in own(column(batch, "text")):
                rows, at = [], 0
                for g in (x for word in words for x in word[1].split(";")):
                    a, b = ([*map(int, ids.split(","))] for ids in g.split("|"))
                    start, at = at, at + sum(len(own.sides[0][i]) for i in a)
                    rows.append({"a": a, "b": b, "start": start, "end": at})
                out.append(rows)
            yield record(pa.schema([("doc_id", pa.int64()), ("groups", group)]), batch.column("doc_id"), pa.array(out, group))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(narrow, run, "doc_id long, groups array<struct<a:array<int>,b:array<int>,start:long,end:long>>")
