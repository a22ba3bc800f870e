"""Top-k search, tokenizer alignment and conversation repair against brute force, on odd cases and empty tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querysmith.llm import alignment, conversations, topk

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Top-k search


def best_of(rows, k=20):
    """(query_id, rank, vec_id, score) by all pairs; rows are (id, vector)."""
    out = []
    usable = [(n, i, [math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, i, q in usable:
        if i is None or i % 20:
            continue
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j, m) for m, j, v in usable if m != n and len(v) == len(q)]
        scores.sort(key=lambda s: (-s[0], math.inf if s[1] is None else s[1], s[2]))
        out += [(i, r, j, s) for r, (s, j, _) in enumerate(scores[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.standard_normal(6) * 0.2]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]  # a third of all rows
    rows += [(20, rows[7][1]), (40, rows[40][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(2000, None), (2020, []), (2021, []), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [math.nan] + [0.0] * 5), (2061, [math.inf] + [0.0] * 5), (2080, [0.0] * 6), (2100, [1.0, 2.0]), (2101, [3.0, 1.0])]
    return rows


@pytest.mark.parametrize("shard_rows", [1 << 18, 150])
def test_topk(spark, vectors, shard_rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, shard int, rid string")
    got = topk.search(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows)
    assert Counter(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == best_of(vectors)


def test_topk_with_large_numbers(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(4) * 10.0 ** int(rng.integers(0, 9))]) for i in range(80)]
    rows += [(100, [1e16, 1.0, 0.0, 0.0]), (120, [1e300, -1e308, 1.5e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())) == best_of(rows)


def test_topk_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = topk.search(spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [2.0])], schema), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 8192), (0, 2, 1, 2048)]


def test_tree_opens_few_boxes():
    rng = np.random.default_rng(1)
    points = np.rint(rng.standard_normal((5000, 3)) * 64)
    tree = topk.Tree(points, np.arange(5000), np.arange(5000), 5)
    assert all(len(rows) <= topk.LEAF for rows, _, _ in tree.leaves)
    opened = []
    tree.leaves = [Opened(x, opened) for x in tree.leaves]
    query = points[17]
    got = tree.search(query, tree.bounds(query[None])[0].tolist(), -1, 5, -math.inf)
    want = sorted((-int(s), i, i) for i, s in enumerate(points @ query))[:5]
    assert got == want and len(opened) < len(tree.leaves) / 4
    assert tree.search(query, tree.bounds(query[None])[0].tolist(), -1, 5, -want[0][0] + 1) == []  # nothing reaches it


class Opened:
    def __init__(self, leaf, seen):
        self.leaf, self.seen = leaf, seen

    def __iter__(self):
        self.seen.append(1)
        return iter(self.leaf)


# Tokenizer alignment


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    return a, b, *own_bytes(a, b)


def own_bytes(a, b):
    """Bytes of tokens by decoding: of A by its decoder's table, of B by its pieces."""
    table, extra = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[chr(byte)] = byte
        else:
            table[chr(extra)] = byte
            extra += 1
    of_a = lambda i: bytes(table[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, of_b


def by_offsets(text, sides):
    """Ids, groups and links by byte offsets of all tokens of the whole text."""
    a, b, of_a, of_b = sides
    if not text:
        return None
    xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(map(of_a, xs)) == (" " + text).encode() == b"".join(map(of_b, ys)):
        return None
    ends = lambda ids, of: list(itertools.accumulate(len(of(i)) for i in ids))
    ea, eb = ends(xs, of_a), ends(ys, of_b)
    cuts = sorted({*ea} & {*eb})
    groups, i, j = [], 0, 0
    for cut in cuts:
        p, q = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append((xs[i:p], ys[j:q]))
        i, j = p, q
    spans = lambda e: list(zip([0, *e], e, strict=False))
    links = [(x, y) for x, (s, e) in zip(xs, spans(ea), strict=True) for y, (t, f) in zip(ys, spans(eb), strict=True) if s < f and t < e]
    return xs, ys, groups, links


def aligned(texts, sides):
    found = [(i, by_offsets(t, sides)) for i, t in texts]
    held = Counter(x for _, f in found if f for x in {*f[3]})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        xs, ys, groups, links = f
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(xs), len(ys), len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), sha(shown)))
    return Counter(out)


ODD = ["<s> </s> <unk> <0x41>", "<|endoftext|> x", "▁", "a ▁b", " ", "  ", " x", "x ", "a  b", "a\tb \n\n c", "\x00 \x1c \x85 x", "ﬁ é 日本語 🙂🙂", " x　y", "don't  can't 12345 , ..", "x" * 70 + " y"]


@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK, 100])
def test_alignment(spark, docs, plain, sides, chunk_bytes):
    texts = [(i, t) for i, t in plain if len(t) < 3500] + [(500 + n, t) for n, t in enumerate(ODD)]
    more = spark.createDataFrame([(500 + n, t) for n, t in enumerate(ODD)], "doc_id long, text string")
    df = docs.filter("text IS NULL OR length(text) < 3500").unionByName(more, allowMissingColumns=True)
    got = alignment.align(df, BYTE_LEVEL, PIECES, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == aligned(texts, sides)


def test_alignment_of_no_rows_and_groups(spark, docs, sides):
    assert alignment.align(docs.limit(0), BYTE_LEVEL, PIECES).count() == 0
    text = "Über den don't  wolken 日本 x."
    [row] = alignment.groups(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE_LEVEL, PIECES).collect()
    data, (_, _, of_a, of_b) = (" " + text).encode(), sides
    assert [(g["a"], g["b"]) for g in row["groups"]] == by_offsets(text, sides)[2]
    for g in row["groups"]:
        assert b"".join(map(of_a, g["a"])) == b"".join(map(of_b, g["b"])) == data[g["start"] : g["end"]]


def test_link_counts(spark, sides):
    texts = [(1, "the word the word"), (2, "the world"), (3, None)]
    got = alignment.link_counts(spark.createDataFrame(texts, "doc_id long, text string"), BYTE_LEVEL, PIECES).collect()
    held = Counter(x for _, t in texts if t for x in {*by_offsets(t, sides)[3]})
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in got} == dict(held)
    assert {(r["a_id"], r["b_id"]) for r in got if r["best"]} == {x for x in held if held[x] == max(n for y, n in held.items() if y[0] == x[0])}


def test_transducer_on_random_cuts():
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        cut = lambda: [data[i:j] for i, j in itertools.pairwise(sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(4))}))]  # noqa: E731, B023
        x, y = cut(), cut()
        ex, ey = (list(itertools.accumulate(map(len, z))) for z in (x, y))
        groups, links = alignment.Transducer(x, y).align([*range(len(x))], [*range(len(y))])
        assert len(groups) == len({*ex} & {*ey}) and len(links) == len(x) + len(y) - len(groups)
        assert sorted(links) == sorted((p << 32) | q for p in range(len(x)) for q in range(len(y)) if ex[p] - len(x[p]) < ey[q] and ey[q] - len(y[q]) < ex[p])
    assert alignment.Transducer([b"ab"], [b"ac"]).align([0], [0]) is None
    assert alignment.Transducer([b"ab"], [b"a"]).align([0], [0]) is None and alignment.Transducer([b"a"], [b"a", b"b"]).align([0], [0, 1]) is None


# Conversation repair


def cheapest(symbols):
    """Cost and edits by the rows from behind, with all edits written out; symbols are (initial, fault). More than
    two inserts in a row never pay."""
    states = ["", "s", "u", "a"]
    ahead = {"": (0, ""), "a": (0, ""), "s": (math.inf, ""), "u": (math.inf, "")}
    spread = lambda found: {s: min([found[s], *((found[t][0] + 2 * n, "I" * n + found[t][1]) for (p, t), n in {("", "u"): 1, ("", "a"): 2, ("s", "u"): 1, ("s", "a"): 2, ("u", "a"): 1, ("a", "u"): 1}.items() if p == s)]) for s in states}
    ahead = spread(ahead)
    for initial, fault in reversed(symbols):
        here = {}
        for state in states:
            options = [(3 + ahead[state][0], "D" + ahead[state][1])]
            for new in {"": "su", "s": "u", "u": "a", "a": "u"}[state] if fault not in ("b", "d") else "":
                more = fault == "t"
                if new == initial:
                    options.append((more + ahead[new][0], "K" + ahead[new][1]))
                if new != "s":
                    options.append((2 + more + ahead[new][0], "R" + ahead[new][1]))
            here[state] = min(options)
        ahead = spread(here)
    return ahead[""]


def expected(rows):
    """All columns by the contract's words; rows are (conv_id, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        own = after[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols = set(), []
        for _, role, text in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            symbols.append((role[:1], "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else ""))
            seen.add((role, text))
        faults = Counter(f for _, f in symbols)
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = cheapest(symbols)
        lines, state, queue = [], "", iter(own)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(queue)
            if edit == "D":
                continue
            new = role[:1] if edit == "K" else "a" if state == "u" else "u"
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[new]}:{text}")
            state = new
        assert next(queue, None) is None
        illegal = sum(x + y not in ("su", "ua", "au") for (x, _), (y, _) in itertools.pairwise(symbols))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["b"], faults["d"], faults["t"], illegal, cost, audit, sha("\n".join(lines))))
    return Counter(out)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(4)
    texts = ["Hello.", "Why?", "no end", "  ", "", "Fine!  \n", "tail.\x85", "é.", "日本", None, "a.b.c.", "?"]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown", "User"]
    rows = []
    for conv in range(150):
        plainly = conv % 3 == 0
        for turn in range(rng.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if plainly else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]) if conv % 5 == 0 else turn, role, f"Text {turn}." if plainly else rng.choice(texts)))
    rows += [(1000, t, rng.choice(roles[:3]), rng.choice([f"T{t}.", f"t{t}"])) for t in range(700)]  # a third of all rows
    rows += [rows[5], rows[5], (None, 0, "user", "Null."), (None, None, None, None)]
    rows += [(2000 + i, 0, "user", "Gone?") for i in range(40)]  # of some nothing is left
    return rows


@pytest.fixture(scope="module")
def turned(spark, turns):
    return spark.createDataFrame([(*r, "x", True) for r in turns], "conv_id long, turn long, role string, text string, audit string, gone boolean").repartition(7)


def test_repair(turned, turns):
    got = conversations.repair_digests(conversations.damaged(turned))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got, want = Counter(map(tuple, got.collect())), expected(turns)
    assert got == want
    assert any(r[7] == "" and r[8] == sha("") for r in want) and any(r[7].count("K") > 2 for r in want)


def test_repair_writes_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "A."), (1, 3, "user", "cut"), (2, 0, "user", " "), (3, 5, None, "x.")]
    got = sorted(map(tuple, conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    # Deleting a row costs as much as keeping it, cut, or giving it a role, with an answer; D comes before K and R.
    assert got == [(1, 0, "system", "S."), (1, 1, "user", ""), (1, 2, "assistant", "A.")]


def test_repair_of_no_rows(turned):
    assert conversations.repair_digests(conversations.damaged(turned.limit(0))).count() == 0


def test_edits_of_all_short_signatures():
    """Every signature of up to four rows, and random longer ones; the trie gives the same whatever came before."""
    symbols = [("s", ""), ("u", ""), ("a", ""), ("o", ""), ("s", "t"), ("u", "t"), ("a", "t"), ("o", "t"), ("u", "b")]
    show = lambda x: "x" if x[1] == "b" else x[0].upper() if x[1] else x[0]
    rng = random.Random(6)
    cases = [c for n in range(5) for c in itertools.product(symbols, repeat=n)] + [tuple(rng.choices(symbols, k=rng.randint(5, 40))) for _ in range(400)]
    by = {"".join(map(show, c)): c for c in cases}
    for signature, cost, audit in conversations.repairs(iter(sorted(by))):
        assert (cost, audit) == cheapest(by[signature]), signature


def test_layers_are_worked_out_once(monkeypatch):
    made = []
    monkeypatch.setattr(conversations, "layer", lambda above, symbol, own=conversations.layer: made.append(1) or own(above, symbol))
    signatures = sorted({"ua" * n + end for n in range(50) for end in ("", "s", "x")})
    assert len([*conversations.repairs(iter(signatures))]) == len(signatures)
    assert len(made) == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
