"""Conversation structure repair: cheapest edits of role sequences by dynamic programming over a prefix trie."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import hot_join, map_arrow, record, settle

#: Ends of sentences and white space (fixed values of the contract).
FULL, ENDS, SPACES = "[.!?]", (".", "!", "?"), " \t\n\x0b\f\r"
#: Costs of edits; a truncated row that stays costs more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of what has been written: nothing, a system message alone, a user's or an assistant's message last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that lead from one state to another.
INSERTED = {(NOTHING, USER): 1, (SYSTEM, USER): 1, (ASSISTANT, USER): 1, (USER, ASSISTANT): 1, (NOTHING, ASSISTANT): 2, (SYSTEM, ASSISTANT): 2} | {(s, s): 0 for s in range(4)}
#: The states behind which a message with this role may come.
FOLLOWS = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (NOTHING,)}


class Best(NamedTuple):
    """The cheapest edits up to a row that end in a state: cost above the layer's cheapest, place among the states'
    edits in ASCII order, the state before, and the edits since then (inserts and what becomes of the row)."""

    cost: int
    place: int
    before: int
    edits: str


#: By state; None where no edits end in it.
Layer = tuple[Best | None, ...]
START: Layer = (Best(0, 0, NOTHING, ""), None, None, None)


@lru_cache(maxsize=65_536)
def layer(above: Layer, symbol: str) -> tuple[Layer, int]:
    """One row more, and by how much the cheapest cost grows. Symbols: the role's initial (o: another), upper case if
    truncated; x for a row that has to go.

    All edits of a layer end with the edit of its row, so none is the beginning of another: two that come
    from different states compare as those do, which is all that ASCII order needs. Costs are relative, so
    there are few different layers, and a path of them takes a reference a row.
    """
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(target: int, cost: int, state: int, edits: str) -> None:
        key = (cost, above[state].place, edits, state)
        if target not in found or key < found[target]:
            found[target] = key

    role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
    extra = TRUNCATED if symbol.isupper() else 0
    for (state, target), n in INSERTED.items():
        if above[state] is None:
            continue
        edits, cost = "I" * n, above[state].cost + n * INSERT
        offer(target, cost + DELETE, state, edits + "D")
        for new in (SYSTEM, USER, ASSISTANT) if symbol != "x" else ():
            if target in FOLLOWS[new]:
                if new == role:
                    offer(new, cost + KEEP + extra, state, edits + "K")
                if new != SYSTEM:
                    offer(new, cost + REROLE + extra, state, edits + "R")
    order = sorted(found, key=lambda t: found[t][1:3])
    least = min(f[0] for f in found.values())
    return tuple(Best(found[t][0] - least, order.index(t), found[t][3], found[t][2]) if t in found else None for t in range(4)), least


def repairs(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """Cost and edits of each sorted signature, from a trie of their prefixes. Inserted in order, a signature shares
    the nodes of the prefix that it has in common with the one before, so only the nodes on the path to the
    last one are held, and a node's layer is worked out once."""
    path, costs, last = [START], array("q", [0]), ""
    for signature in signatures:
        shared = len(commonprefix([last, signature]))
        del path[shared + 1 :], costs[shared + 1 :]
        for symbol in signature[shared:]:
            node, more = layer(path[-1], symbol)
            path.append(node)
            costs.append(costs[-1] + more)
        last = signature
        yield signature, *terminal(path, costs[-1])


def terminal(path: list[Layer], cost: int) -> tuple[int, str]:
    """The answer at a terminal node: closed by inserts, then followed back to the root."""
    ends = [(path[-1][state].cost + n * INSERT, path[-1][state].place, "I" * n, state) for (state, end), n in INSERTED.items() if path[-1][state] is not None and end in (NOTHING, ASSISTANT)]
    more, _, edits, state = min(ends)
    parts = [edits]
    for node in path[:0:-1]:
        parts.append(node[state].edits)
        state = node[state].before
    return cost + more, "".join(reversed(parts))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of `conv_id:turn` modulo 20 (a null is one space): 0 drops a row, 1 empties its
    text, 2 removes its ends of sentences, 3 repeats it, 4 makes its role user. Columns conv_id, turn, role, text,
    gone (of a row that was dropped, only its conversation is left)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(filled("text"), FULL, "")).otherwise(filled("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), "text", kind.alias("kind"))
    return rows.select("conv_id", "turn", "role", text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies)).drop("col")


_COUNTS = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")] + [("signature", pa.string())])
_COUNTED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
LEGAL = {"su", "ua", "au"}


class Tally:
    """Faults of one conversation, whose rows come in order; of them only the signature is held, a byte a row."""

    def __init__(self, conv: int | None):
        self.conv, self.faults, self.illegal, self.signature = conv, {"b": 0, "d": 0, "t": 0, "": 0}, 0, bytearray()
        self.last, self.low, self.high, self.turns = None, None, None, 0

    def add(self, turn: int | None, initial: str, fault: str, symbol: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        self.signature += symbol.encode()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.signature.decode()


def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now = None
    for batch in batches:
        for conv, gone, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "initial", "fault", "symbol")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now.row()
                now = Tally(conv)
            if not gone:
                now.add(*row)
    if now is not None:
        yield now.row()


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    while few := list(islice(rows, size)):
        yield record(schema, *map(list, zip(*few, strict=True)))


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired conversation: rows (role, text) by the edits. Only the first message can be a
    system's; behind it users and assistants take turns, so the edits settle every role."""
    expected, first = USER, True
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and first and role[:1] == "s":
            yield role, text
        else:
            yield (role if edit == "K" else NAMES[expected]), text
            expected = USER + ASSISTANT - expected
        first = False


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Each conversation and its repaired messages, to be read before the next one; its edits come before its rows,
    of which one is held at a time."""
    rows = ((c, *x) for batch in batches for c, *x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True))
    for (conv, _), own in groupby(rows, key=_turned()):
        _, audit, *_ = next(own)
        yield conv, repaired(((r[2], r[3]) for r in own), audit)


def _turned():
    """A key that changes with each row of edits, so that conversations are told apart even where ids repeat."""
    number = 0

    def key(row: tuple) -> tuple:
        nonlocal number
        number += row[1] is not None
        return row[0], number

    return key


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, messages in streamed(batches):
        for position, (role, text) in enumerate(messages):
            yield conv, position, role, text


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, messages in streamed(batches):
        digest = hashlib.sha256()
        for position, (role, text) in enumerate(messages):
            digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        yield conv, digest.hexdigest()


def _rows(turns: DataFrame) -> DataFrame:
    """Rows as they count: nulls are one space; one partition has all of a conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), gone.alias("gone")).repartition(parts, "conv_id")


IN_ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "text")


def audit(turns: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each conversation (see repair): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit."""
    rows = _rows(turns)
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    seen = Window.partitionBy("conv_id", "gone", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    fault = F.when(end == "", "b").when(F.col("nth") > 1, "d").when(~end.isin(*ENDS), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(kept)).otherwise(kept)
    faults = rows.withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault).sortWithinPartitions("conv_id", *(f(c) for f, c in IN_ORDER))
    narrow = faults.select("conv_id", "gone", "turn", initial.alias("initial"), "fault", symbol.alias("symbol"))
    found = settle(map_arrow(narrow, lambda b: batched(tallies(b), _COUNTS), _COUNTED))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = found.select("signature").distinct().repartitionByRange(parts, "signature").sortWithinPartitions("signature")
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    answers = settle(map_arrow(distinct, lambda b: batched(repairs(s for x in b for s in x.column(0).to_pylist()), schema), "signature string, cost long, audit string"))
    return hot_join(found, answers, "signature", found.count()).drop("signature")


def _streams(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of each conversation in order, behind its edits."""
    none = F.lit(None).cast("string")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(turns).filter(~F.col("gone")).select("conv_id", none.alias("audit"), "turn", "role", "text")
    both = audits.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text")).unionByName(rows)
    return both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *(f(c) for f, c in IN_ORDER))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, position, role, text.

    Rows (conv_id, turn, role, text) are taken by turn, nulls first, then by role and text. Blank rows and those
    whose role and text were seen before in the conversation go; others are kept (free), given another role
    (2), or deleted (3), and empty messages of a user or an assistant are inserted (2), so that what is left
    is an optional system message and then pairs of user and assistant, or nothing, at the least cost; a
    truncated row that stays costs 1. Ties are settled by the edits' initials in ASCII order.

    Conversations become signatures, a symbol a row; distinct signatures, sorted, go through a prefix trie whose
    nodes each hold one layer of the dynamic programme, and answers join back. A conversation's rows pass one
    task in order, as its digest needs, but aren't held there: its signature and edits are, a byte a row.

    Null roles and texts are one space; null turns come first; rows without conv_id are one conversation; repeated
    rows count as duplicates; empty conversations stay empty; an empty table gives no rows; other columns are
    ignored but for a boolean `gone`, which marks rows that aren't there (their conversation still is).
    """
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return map_arrow(_streams(turns, audit(turns)), lambda b: batched(_written(b), schema), "conv_id long, position long, role string, text string")


def repair_digests(turns: DataFrame) -> DataFrame:
    """audit() with the SHA-256 of each repaired conversation (`role:text`, joined by newlines) as repaired_sha256."""
    audits = settle(audit(turns))
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    digests = map_arrow(_streams(turns, audits), lambda b: batched(_digested(b), schema), "id long, repaired_sha256 string")
    return audits.join(digests, audits["conv_id"].eqNullSafe(digests["id"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
