"""Class-based n-gram language model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats
from .base import forget, hot_join, importable, map_arrow, record, settle, slices
from .packing import only

#: Words whose counts are broadcast and that are clustered on their own, the length in bytes from which digests stand for words,
#: units that all other words share by their ends, least number of classes, most rounds of exchange.
KNOWN, KNOWN_BYTES, ENDINGS, CLASSES, ROUNDS = 150_000, 64, 128, 64, 4
#: Weight of the class frequencies in a class's transitions; words and bigrams a worker counts before it
#: hands them on; units of a block, and least number of blocks; counts that a block gathers before it adds them up;
#: bytes of texts that are handled at once.
SMOOTHING, FLUSH, PAIRS, UNITS, BLOCKS_LEAST, GATHERED, SLICE = 20.0, 300_000, 2_000_000, 1024, 16, 4_000_000, 2 << 20


def short(word: bytes) -> bytes:
    """The word, or for one longer than KNOWN_BYTES a digest that no word can be (it starts with a space)."""
    return word if len(word) <= KNOWN_BYTES else b" " + hashlib.md5(word).digest()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def hash_of_long(word: bytes) -> int:
    return xxhash.xxh64_intdigest(short(word))


class Texts:
    """The words of a batch of texts, A-Z lower-cased, as arrays: hash, start, end, text; each text ends with an end token."""

    def __init__(self, texts: list[bytes | None]):
        parts = [t.lower() if t else b"" for t in texts]
        self.bytes = b"".join(parts)
        self.hash, self.start, self.end, self.counts = repeats.words_of(self.bytes, np.cumsum([len(p) for p in parts]).tolist(), KNOWN_BYTES, hash_of_long)
        self.distinct, self.first, self.of, self.n = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)
        # Places of the words among all tokens, and where each text's tokens start.
        self.begin = np.cumsum(self.counts + 1) - (self.counts + 1)
        self.place = np.arange(len(self.hash)) + np.repeat(np.arange(len(parts)), self.counts)

    def word(self, i: int) -> bytes:
        return short(self.bytes[self.start[i] : self.end[i]])

    def tokens(self, values: np.ndarray) -> np.ndarray:
        """Values of the words with a zero after each text."""
        out = np.zeros(len(values) + len(self.counts), values.dtype)
        out[self.place] = values
        return out


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class Joint:
    """Bigram counts of classes, and moves of units between them.

    The likelihood of a class bigram model is sum phi(N(c, d)) - sum phi(N(c, .)) - sum phi(N(., d)), where
    phi(x) = x ln x.
    """

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.float64)
        self.rows, self.cols, self.phi = self.n.sum(1), self.n.sum(0), phi(self.n)

    def likelihood(self) -> float:
        return float(self.phi.sum() - phi(self.rows).sum() - phi(self.cols).sum())

    def move(self, right: np.ndarray, left: np.ndarray, self_n: float, old: int) -> int:
        """Put a unit of class old, with counts of classes after and before it (without itself), into the class that most raises the likelihood."""
        n, out, into = self.n, right.sum() + self_n, left.sum() + self_n
        n[old] -= right
        n[:, old] -= left
        n[old, old] -= self_n
        self.rows[old] -= out
        self.cols[old] -= into
        self.phi[old], self.phi[:, old] = phi(n[old]), phi(n[:, old])
        r, le = np.flatnonzero(right), np.flatnonzero(left)
        gain = (phi(n[:, r] + right[r]) - self.phi[:, r]).sum(1) + (phi(n[le] + left[le, None]) - self.phi[le]).sum(0)
        d = n.diagonal()
        gain += phi(d + right + left + self_n) - phi(d + right) - phi(d + left) + phi(d)
        gain -= phi(self.rows + out) - phi(self.rows) + phi(self.cols + into) - phi(self.cols)
        gain[0] = -np.inf
        new = int(gain.argmax())
        if gain[new] <= gain[old] + 1e-9:
            new = old
        n[new] += right
        n[:, new] += left
        n[new, new] += self_n
        self.phi[new], self.phi[:, new] = phi(n[new]), phi(n[:, new])
        self.rows[new] += out
        self.cols[new] += into
        return new


def dealt_classes(total: np.ndarray, classes: int) -> np.ndarray:
    """First classes: units by falling count in turn; unit 0 (the end of a text) has class 0 for itself."""
    of = np.zeros(len(total), np.int64)
    of[np.argsort(-total[1:], kind="stable") + 1] = 1 + np.arange(len(total) - 1) % max(1, classes - 1)
    return of


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: units move, one after another, to the class that most raises the likelihood."""
    n = bigrams.astype(np.float64)
    total = n.sum(0) + n.sum(1)
    of = dealt_classes(total, classes)
    if classes < 3:
        return of
    member = np.eye(classes)[of]
    joint = Joint(member.T @ n @ member)
    for _ in range(rounds):
        moved = 0
        for u in np.flatnonzero(total[1:]) + 1:
            old = of[u]
            member[u, old] = 0
            of[u] = joint.move(n[u] @ member, n[:, u] @ member, n[u, u], old)
            member[u, of[u]] = 1
            moved += of[u] != old
        if not moved:
            break
    return of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    counts: Counter = Counter()
    only()
    for batch in slices(batches, size=SLICE):
        t = Texts(batch.column("text").to_pylist())
        for i, n in zip(t.first.tolist(), t.n.tolist(), strict=True):
            counts[t.word(i)] += n
        if len(counts) > FLUSH:
            yield record(kind, list(counts), list(counts.values()))
            counts = Counter()
    if counts:
        yield record(kind, list(counts), list(counts.values()))


class Units:
    """Numbers of words: known words by rank from 1, others after them by their ending; 0 is the end."""

    def __init__(self, known: list[bytes]):
        self.known = len(known) + 1
        self.count = self.known + ENDINGS
        plain = [w for w in known if not w.startswith(b" ")]
        hashes = dict(zip(plain, repeats.word_hashes(b" ".join(plain))[0].tolist(), strict=True))
        own = np.array([hashes[w] if w in hashes else xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        self.rank = np.argsort(own)
        self.sorted = own[self.rank]

    def numbers(self, t: Texts) -> np.ndarray:
        """The number of each word; each distinct word is looked up once."""
        if not len(t.distinct):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, t.distinct), max(0, len(self.sorted) - 1))
        hit = self.sorted[at] == t.distinct if len(self.sorted) else np.zeros(len(t.distinct), bool)
        out = np.empty(len(t.distinct), np.int64)
        out[hit] = self.rank[at[hit]] + 1
        far = np.flatnonzero(~hit)
        out[far] = [self.known + ending(t.word(i)) for i in t.first[far].tolist()]
        return out[t.of]


_units: dict[str, Units] = {}


def _units_of(known) -> Units:
    """One table for each broadcast, as long as the worker lives."""
    if known.id not in _units:
        _units.clear()
        _units[known.id] = Units(known.value)
    return _units[known.id]


class Handle:
    """A broadcast with an identity that workers can keep things by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


BLOCKS = pa.schema([("block", pa.int32()), ("into", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary())])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, by byte planes, which compress."""
    steps = np.diff(keys, prepend=np.int64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64))


def _bigrams(batches: Iterator[pa.RecordBatch], known, blocks: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours, packed: for each block of units those after (key: unit, other) and before (into)."""
    units = _units_of(known)
    only()
    keys: list[np.ndarray] = []

    def summed() -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        keys.clear()
        a, b = found // units.count, found % units.count
        for into, unit, other in ((False, a, b), (True, b, a)):
            block = unit % blocks
            key = unit * units.count + other
            order = np.lexsort((key, block))
            block, key, count = block[order], key[order], n[order].astype(np.int32)
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            cut = list(zip(edges, edges[1:]))  # noqa: B905
            yield record(BLOCKS, block[edges[:-1]].tolist(), [into] * len(cut), [_pack(key[i:j]) for i, j in cut], [count[i:j].tobytes() for i, j in cut])

    for batch in slices(batches, size=SLICE):
        t = Texts(batch.column("text").to_pylist())
        chain = np.concatenate([np.zeros(1, np.int64), t.tokens(units.numbers(t))])
        keys.append(chain[:-1] * units.count + chain[1:])
        if sum(map(len, keys)) > PAIRS:
            yield from summed()
    if sum(map(len, keys)):
        yield from summed()


SIDES = ("out", "into")
ROWS = pa.schema([("block", pa.int32()), *((f"{side}_{part}", pa.binary()) for side in SIDES for part in ("keys", "n"))])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with their counts, those of equal keys added up."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
    n = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's counts of all tasks, added up; rows come by block. However many tasks have counted, a block holds
    its different bigrams and GATHERED counts more, so a hot unit takes as much as it has neighbours."""
    now, parts, held = None, {False: [], True: []}, 0

    def solved() -> pa.RecordBatch:
        row: list = [[now]]
        for into in (False, True):
            keys, n = _summed(parts[into])
            row += [[_pack(keys)], [n.tobytes()]]
        return record(ROWS, *row)

    for batch in batches:
        for block, into, keys, n in zip(*(batch.column(c).to_pylist() for c in ("block", "into", "keys", "n")), strict=True):
            if block != now:
                if now is not None:
                    yield solved()
                now, parts, held = block, {False: [], True: []}, 0
            parts[into].append((_unpack(keys), np.frombuffer(n, np.int32).astype(np.int64)))
            held += len(n) // 4
            if held > GATHERED:
                parts, held = {i: [_summed(p)] for i, p in parts.items()}, 0
    if now is not None:
        yield solved()


def _blocks(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each block its sides (after, before): unit, neighbour, how often; sorted by unit."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for side in SIDES:
                keys, n = _unpack(batch.column(f"{side}_keys")[i].as_py()), np.frombuffer(batch.column(f"{side}_n")[i].as_py(), np.int64)
                sides.append((keys // count, keys % count, n))
            yield sides


def _joint(batches: Iterator[pa.RecordBatch], model, blocks: int) -> Iterator[pa.RecordBatch]:
    of, classes = model.value
    sums = np.zeros(classes * classes, np.int64)
    for (unit, other, n), _ in _blocks(batches, len(of)):
        sums += np.bincount(of[unit] * classes + of[other], n, classes * classes).astype(np.int64)
    if sums.any():
        parts = [a.tobytes() for a in np.array_split(sums.reshape(classes, classes), blocks)]
        yield record(pa.schema([("block", pa.int32()), ("counts", pa.binary())]), list(range(blocks)), parts)


def _moves(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """One round of exchange over the units of each block, which sees the moves of its own units only, so that they
    follow from the block whatever else a task has to do."""
    before, counts = model.value
    moved, classes = {}, len(counts)
    for out, into in _blocks(batches, len(before)):
        of, joint = before.copy(), Joint(counts)
        units = np.union1d(out[0], into[0])
        edges = [np.searchsorted(side[0], np.append(units, len(of))) for side in (out, into)]
        for k, u in enumerate(units.tolist()):
            if not u:
                continue
            (ro, rn), (lo, ln) = ((side[1][e[k] : e[k + 1]], side[2][e[k] : e[k + 1]]) for side, e in zip((out, into), edges, strict=True))
            own = float(rn[ro == u].sum())
            right, left = np.bincount(of[ro], rn, classes), np.bincount(of[lo], ln, classes)
            right[of[u]] -= own
            left[of[u]] -= own
            new = joint.move(right, left, own, of[u])
            if new != of[u]:
                of[u] = moved[u] = new
    if moved:
        yield record(pa.schema([("unit", pa.int32()), ("class", pa.int32())]), list(moved), [int(c) for c in moved.values()])


def cluster(training: DataFrame, share: Handle, total: np.ndarray, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and bigram counts of classes: exchange over sparse rows of bigram counts, in blocks of units.

    The rows stay in Spark; in each round every block moves its units, given the classes that all units had
    before. Only classes of units and counts of classes reach the driver. Moves that blocks make beside each
    other can lower the likelihood; then the best classes found are kept. Blocks follow from the number of units
    alone, so classes are the same on any cluster and however files are split.
    """
    sc = training.sparkSession.sparkContext
    blocks = max(BLOCKS_LEAST, -(-len(total) // UNITS))
    sent = map_arrow(training, lambda b: _bigrams(b, share, blocks), "block int, into boolean, keys binary, n binary")
    dealt = sent.repartitionById(blocks, F.col("block")).sortWithinPartitions("block")
    rows = settle(map_arrow(dealt, _merged, "block int, out_keys binary, out_n binary, into_keys binary, into_n binary"))
    parts_of = 8

    def counted(of: np.ndarray) -> np.ndarray:
        model = sc.broadcast((of, classes))
        parts = map_arrow(rows, lambda b: _joint(b, model, parts_of), "block int, counts binary")
        found = {r["block"]: r["counts"] for r in map_arrow(parts.repartition(parts_of, "block"), _add, "block int, counts binary").collect()}
        return np.concatenate([np.frombuffer(found[b], np.int64) for b in range(parts_of)]).reshape(classes, classes) if found else np.zeros((classes, classes), np.int64)

    of = dealt_classes(total, classes)
    best = (of, counted(of))
    for _ in range(rounds):
        model = sc.broadcast(best)
        moved = map_arrow(rows, lambda b, model=model: _moves(b, model), "unit int, class int").collect()
        of = best[0].copy()
        for r in moved:
            of[r["unit"]] = r["class"]
        joint = counted(of) if moved else best[1]
        if not moved or Joint(joint).likelihood() <= Joint(best[1]).likelihood():
            break
        best = (of, joint)
    forget(rows)
    return best


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(counts, np.int64)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield record(pa.schema([("block", pa.int32()), ("counts", pa.binary())]), list(sums), [a.tobytes() for a in sums.values()])


LOCAL = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double, tail array<struct<word:binary,n:int,class:int>>"


def _score(batches: Iterator[pa.RecordBatch], known, model) -> Iterator[pa.RecordBatch]:
    """Everything but the counts of words that aren't broadcast; those words are handed on with their class."""
    units, m = _units_of(known), model.value
    kinds = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("class", pa.int32())]))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known")), *((n, pa.float64()) for n in ("base_log", "score")), ("tail", kinds)])
    rid = TaskContext.get().partitionId() << 40
    log_c, log_more, seen = np.log10(np.maximum(m["counts"], 1)), np.log10(m["counts"] + 1), m["counts"] > 0
    only()
    for batch in slices(batches, size=SLICE):
        t = Texts(batch.column("text").to_pylist())
        numbers = units.numbers(t)
        at = t.tokens(numbers)
        c = m["class_of_unit"][at]
        near = at < units.known
        known = np.where(near, at, 0)
        # A text starts after the end token of the one before it, which is the class of all starts.
        score = m["transition"][np.concatenate([[0], c[:-1]]), c] - m["class_total"][c] + np.where(near, np.where(seen[known], log_c[known], m["unknown"][c]), 0.0)
        sums = [np.add.reduceat(x, t.begin) for x in (score, np.where(near, log_more[known], 0.0), (near & seen[known]).astype(np.int64))]
        far = np.flatnonzero(numbers >= units.known)
        text = np.repeat(np.arange(len(t.counts)), t.counts)[far]
        pair, first, n = np.unique(text * len(t.distinct) + t.of[far], return_index=True, return_counts=True) if len(far) else (far, far, far)
        spots = far[first]
        words = pa.array([t.word(i) for i in spots.tolist()], pa.binary())
        tail = pa.StructArray.from_arrays([words, pa.array(n.astype(np.int32)), pa.array(m["class_of_unit"][numbers[spots]].astype(np.int32))], names=["word", "n", "class"])
        offsets = np.searchsorted(text[first] if len(far) else far, np.arange(len(t.counts) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), tail).cast(kinds)
        size = len(t.counts)
        yield record(schema, list(range(rid, rid + size)), batch.column("doc_id"), batch.column("held_out"), (t.counts + 1).tolist(), sums[2].tolist(), sums[1].tolist(), sums[0].tolist(), lists)
        rid += size


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows for which held_out (over the id) is false and score all whole texts.

    P(text) = product of P(class | class before) P(word | class), a text starting after and ending with the
    end token. Classes come from exchange clustering of units: each of the KNOWN words, and ENDINGS
    groups of all others by their last bytes; there are twice as many classes as the cube root of
    the known words, CLASSES at least. Class transitions are smoothed by class frequencies; a word
    has its share c / (N + n1 + 1) of its class's N tokens, and the one type of unseen words the share
    (n1 + 1) / (N + n1 + 1), where n1 is the class's number of words seen once; so the probabilities over
    the training words and one unseen type sum to one, as those of base_score do.

    All training tokens are counted (partial counts in each task, then a shuffle by word). The counts of at
    most KNOWN words are broadcast (a word longer than KNOWN_BYTES stands there and everywhere as a digest); all
    other words meet their counts in a join in which frequent words stay spread. Only KNOWN words and
    the counts of classes reach the driver; bigram counts of units stay in Spark.

    A null text is empty (one end token); null ids count as empty text for the split and are kept; repeated
    rows are scored one by one; without training rows every probability falls back to a constant; an
    empty table gives no rows; other columns are ignored.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_unknown.
    """
    spark = docs.sparkSession
    importable(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = rows.filter(~F.col("held_out")).select("text")
    counted = map_arrow(training, _count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    size = F.floor(F.log2("c") * 8).cast("int")
    unit_end = F.pmod(F.crc32(F.when(F.length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))), F.lit(ENDINGS)).cast("int")
    counts = settle(counted.withColumn("size", size).withColumn("ending", unit_end))
    sizes = sorted(((r["size"], r["n"]) for r in counts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held, cut = 1 << 30, 0, None
    for at, n in sizes:
        if held + n > KNOWN:
            cut = at  # of this size only the first words are known
            break
        least, held = at, held + n
    found = counts.filter(F.col("size") >= least).select("c", "word").collect()
    if cut is not None and held < KNOWN:
        found += counts.filter(F.col("size") == cut).select("c", "word").orderBy(F.desc("c"), "word").limit(KNOWN - held).collect()
    top = sorted(((r["c"], bytes(r["word"])) for r in found), key=lambda x: (-x[0], x[1]))
    known = [w for _, w in top]
    ends = {r["ending"]: r for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("int")).alias("n1")).collect()}
    n_end = training.count()
    train_tokens = n_end + sum(r["c"] for r in ends.values())
    types = (n_end > 0) + sum(r["v"] for r in ends.values())

    own = len(known)
    share = Handle(sc.broadcast(known))
    unit_n, unit_once = np.zeros(1 + own + ENDINGS), np.zeros(1 + own + ENDINGS)
    unit_n[0] = n_end
    for e, r in ends.items():
        unit_n[1 + own + e], unit_once[1 + own + e] = r["c"], r["n1"]
    for i, (c, w) in enumerate(top):
        unit_n[1 + i], unit_once[1 + i] = c, c == 1
        unit_n[1 + own + ending(w)] -= c
        unit_once[1 + own + ending(w)] -= c == 1
    classes = max(CLASSES, round(2 * own ** (1 / 3)))
    of, joint = cluster(training, share, unit_n, classes)
    class_n, class_once = np.bincount(of, unit_n, classes), np.bincount(of, unit_once, classes)
    frequency = (joint.sum(0) + 1) / (joint.sum() + classes)
    transition = np.log10((joint + SMOOTHING * frequency) / (joint.sum(1, keepdims=True) + SMOOTHING))
    model = sc.broadcast({
        "class_of_unit": of, "transition": transition, "class_total": np.log10(class_n + class_once + 1), "unknown": np.log10(class_once + 1),
        "counts": np.array([n_end, *(c for c, _ in top)], np.float64),
    })

    local = settle(map_arrow(rows, lambda b: _score(b, share, model), LOCAL))
    unknown = F.array(*(F.lit(float(x)) for x in np.log10(class_once + 1)))
    tails = local.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.n", "t.class")
    far = local.agg(F.sum(F.size("tail"))).first()[0] or 0
    met = hot_join(tails, counts.filter(F.col("size") < least).select("word", "c"), "word", far, "left")
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("far_base"),
        F.sum(F.col("n") * F.coalesce(F.log10("c"), F.element_at(unknown, F.col("class") + 1))).alias("far_score"),
    )
    whole = local.drop("tail").join(sums, "rid", "left").fillna(0, ["far_known", "far_base", "far_score"])
    return whole.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.col("far_known")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + F.col("far_base") - F.col("n_tokens") * float(np.log10(train_tokens + types + 1))).alias("base_score"),
        (F.col("score") + F.col("far_score")).alias("score"),
        (F.col("n_tokens") - F.col("n_known") - F.col("far_known")).cast("long").alias("n_unknown"),
    )
