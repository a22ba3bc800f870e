"""Each operator against brute force, round trips or held-out data, on a fixture of odd cases and on empty tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from querysmith.llm import base, byte_bpe, class_lm, components, embedding_dedup, fingerprint, jaccard_join, packing, quality, repeats, sharding, substring_dedup, suffix_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows(df):
    return [tuple(r) for r in df.collect()]


def order(i):
    return math.inf if i is None else i


# Class language model


def test_class_lm(docs, plain):
    got = class_lm.score_texts(docs, quality.held_out("doc_id", 7, 2)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*t.encode().lower().split(), None]
    counts = Counter(x for i, t in plain if not held(i) for x in tokens(t))
    total, types = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in tokens(t)), 6)) for i, t in plain)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert class_lm.score_texts(docs.limit(0), F.lit(False)).count() == 0
    alone = class_lm.score_texts(docs.limit(2), F.lit(True)).collect()  # nothing to learn from
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


def test_class_lm_scores_by_brute_force(docs, plain, monkeypatch):
    """Each text's probability worked out token by token from the classes and counts that were learnt."""
    seen, cluster = {}, class_lm.cluster
    monkeypatch.setattr(class_lm, "cluster", lambda training, share, total, classes, *a: seen.update(known=share.value, total=total, found=cluster(training, share, total, classes, *a)) or seen["found"])
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    got = class_lm.score_texts(docs, quality.held_out("doc_id", 7, 2)).collect()
    key = lambda w: w if w is None or len(w) <= 64 else b" " + hashlib.md5(w).digest()
    tokens = lambda t: [*map(key, t.encode().lower().split()), None]
    counts = Counter(x for i, t in plain if not held(i) for x in tokens(t))
    of, joint = seen["found"]
    unit = {w: k + 1 for k, w in enumerate(seen["known"])} | {None: 0}
    unit_of = lambda w: unit[w] if w in unit else 1 + len(seen["known"]) + zlib.crc32(w[-3:]) % class_lm.ENDINGS
    class_of = lambda w: int(of[unit_of(w)])
    # The bigrams of classes are those of the training texts.
    want = Counter()
    for i, t in plain:
        if not held(i):
            chain = [None, *tokens(t)]
            want.update((class_of(a), class_of(b)) for a, b in zip(chain, chain[1:], strict=False))
    assert {(a, b): int(joint[a, b]) for a, b in zip(*np.nonzero(joint), strict=True)} == dict(want)
    n, once, words = Counter(), Counter(), defaultdict(list)
    for w, c in counts.items():
        n[class_of(w)] += c
        once[class_of(w)] += c == 1
        words[class_of(w)].append(c)
    frequency = (joint.sum(0) + 1) / (joint.sum() + len(joint))
    step = lambda a, b: (joint[a, b] + class_lm.SMOOTHING * frequency[b]) / (joint[a].sum() + class_lm.SMOOTHING)
    emit = lambda w: (counts[w] or once[class_of(w)] + 1) / (n[class_of(w)] + once[class_of(w)] + 1)
    score = lambda t: sum(math.log10(step(class_of(a), class_of(b)) * emit(b)) for a, b in zip([None, *tokens(t)], tokens(t), strict=False))
    assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 5)) for r in got) == Counter((i, len(tokens(t)), round(score(t), 5)) for i, t in plain)
    for c in range(len(joint)):  # both factors are distributions
        assert abs(sum(step(c, d) for d in range(len(joint))) - 1) < 1e-9
        assert abs((sum(words[c]) + once[c] + 1) / (n[c] + once[c] + 1) - 1) < 1e-9


def test_class_lm_beats_unigrams(spark, tiny):
    got = class_lm.score_texts(spark.read.parquet(f"{tiny}/documents.parquet"), quality.held_out("doc_id", 7, 2)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    n = np.zeros((21, 21))
    for _ in range(20_000):  # words of one half follow words of the other
        a, b = rng.integers(1, 11), rng.integers(11, 21)
        n[a, b] += 1
        n[b, a] += rng.random() < 0.5
    of = class_lm.exchange(n, 3, 20)
    assert of[0] == 0 and len({*of[1:11]}) == 1 and len({*of[11:]}) == 1 and of[1] != of[11]


def test_class_lm_clusters_words_past_the_first_thousand(spark):
    rng = np.random.default_rng(1)
    filler = [" ".join(f"f{i}" for i in rng.permutation(1100)) for _ in range(30)]  # these are more frequent
    words = lambda kind: [f"{kind}{i:03d}" for i in rng.permutation(400)]
    texts = filler + [" ".join(w for pair in zip(words("a"), words("b"), strict=True) for w in pair) for _ in range(20)]
    fits, fits_not = texts[-1].split()[:200], sorted(texts[-1].split()[:200])
    rows = [*enumerate(texts), (1000, " ".join(fits)), (1001, " ".join(fits_not))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in class_lm.score_texts(docs, F.col("doc_id") >= 1000).filter("held_out").collect()}
    assert got[1000] > got[1001] + 20  # the same words: only their classes tell the texts apart


def test_class_lm_follows_from_the_data_alone(spark, tiny, monkeypatch):
    """The same scores however the rows are split, and in whatever order counts are added up."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    held = lambda: quality.held_out("doc_id", 7, 2)
    scores = lambda df: {r["doc_id"]: (r["n_known"], round(r["score"], 6)) for r in class_lm.score_texts(df, held()).collect()}
    one = scores(docs.repartition(1))
    for parts, gathered, pairs in ((3, class_lm.GATHERED, class_lm.PAIRS), (11, 500, 2000)):
        monkeypatch.setattr(class_lm, "GATHERED", gathered)
        monkeypatch.setattr(class_lm, "PAIRS", pairs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{parts * 10}k")
        try:
            other = scores(docs.repartition(parts, "doc_id"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert other.keys() == one.keys() and all(other[i][0] == one[i][0] and abs(other[i][1] - one[i][1]) < 1e-5 for i in one)


def test_class_lm_knows_the_first_of_equally_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "KNOWN", 50)
    known = {}
    monkeypatch.setattr(class_lm, "cluster", lambda training, share, *a, own=class_lm.cluster: known.update(words=share.value) or own(training, share, *a))
    docs = spark.createDataFrame([(0, " ".join(f"w{i:03d}" for i in range(200)))], "doc_id long, text string")
    [row] = class_lm.score_texts(docs, F.lit(False)).collect()
    assert known["words"] == [f"w{i:03d}".encode() for i in range(50)] and row["n_known"] == 201 and row["n_unknown"] == 0


# Packing


def test_packing(docs, plain):
    got = packing.pack(docs, WORDS, capacity=256).collect()
    tok = Tokenizer.from_file(WORDS)
    ids = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 2]
    want = Counter()
    for i, t in plain:
        x = ids(t)
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            want[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in got) / (256 * len(sequences)) > 0.9
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_packing_patterns():
    rng = random.Random(2)
    for _ in range(200):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 20))}
        held = Counter()
        for count, pattern in packing.shortest_pack_first(histogram, 64):
            assert count > 0 and sum(pattern) <= 64
            for length in pattern:
                held[length] += count
        assert held == histogram


def test_word_tokenizer_is_the_library():
    tok, ours, rng = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS), random.Random(4)
    parts = ["a", "B", " ", "\n", "\x1c", "\x85", "é", "É", "ß", "İ", "'s", "123", "!!", "日本", "🙂", "<|endoftext|>", "word", "’", "ﬁ", "́", "\x00", "\x07", "²"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(ours(s), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s


# Fingerprints


def test_fingerprints(docs, plain):
    got = fingerprint.compare_with_edits(docs).collect()
    ordered = sorted(plain, key=lambda x: (-x[0] if x[0] is not None else math.inf, x[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 3
        want.append((i, len(t), sha((t[: len(t) - n] + following[:n]).encode())))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    prints = defaultdict(set)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[dict(plain)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    # Fingerprints and likenesses again, each from its own text alone.
    sampler = fingerprint.Sampler()
    shown = lambda t: sampler([t])[0]
    full = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 3
        a, b, c = shown(t), shown(t[: len(t) - n] + following[:n]), shown(following)
        full.append((i, a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    assert Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got) == Counter(full)
    assert fingerprint.compare_with_edits(docs.limit(0)).count() == 0
    assert fingerprint.compare_with_edits(docs.limit(1)).count() == 1
    assert docs.count() == fingerprint.fingerprints(docs).count()


def test_collisions_equal_generalised_jaccard():
    rng, sampler = random.Random(6), fingerprint.Sampler(4096)
    for _ in range(4):
        a, b = ([rng.choice("abcdefghijkl") for _ in range(60)] for _ in range(2))
        x, y = Counter(a), Counter(b)
        p, q = sampler([" ".join(a), " ".join(b)])
        assert abs(fingerprint.likeness(p, q) - sum((x & y).values()) / sum((x | y).values())) < 0.04


def test_production_samples_are_as_exact_as_stated():
    """With 64 samples the mean error is that of 64 draws: at most 0.0625 a comparison, and unbiased."""
    rng, sampler, off = random.Random(7), fingerprint.Sampler(), []
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnop") for _ in range(80)]
        b = [x if rng.random() < 0.8 else rng.choice("abcdefghijklmnop") for x in a]
        x, y = Counter(a), Counter(b)
        p, q = sampler([" ".join(a), " ".join(b)])
        off.append(fingerprint.likeness(p, q) - sum((x & y).values()) / sum((x | y).values()))
    assert abs(sum(off) / len(off)) < 0.02 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.0625


# Sharding


def test_sharding(docs, plain):
    got = sharding.interleave(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in plain)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    assert sorted(shards) == [0, 1, 2, 3] and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for part in shards.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    for source, n in Counter(r["source"] for r in got).items():
        assert all(abs(sum(r["source"] == source for r in part) - n / 4) <= 2 for part in shards.values())
    assert sharding.interleave(docs.limit(0)).count() == 0


# Quality classifier


def test_quality(spark, tiny, docs):
    base = tiny.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = quality.held_out("doc_id", 3, 1)
    weights = quality.fit(d, labels, ~held)
    seen = quality.score(d, weights).join(labels, "doc_id").filter(held).select("score", F.col("quality")).collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in seen) / len(seen) > 0.95
    got = quality.score(docs, weights)  # replaces its column score
    assert got.columns.count("score") == 1 and got.count() == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = quality.fit(docs, labels.limit(0), ~held)
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), weights).count() == 0


def test_quality_by_brute_force(docs, plain, spark):
    """Updates one weight at a time in plain Python, and scores as sums over all words and pairs."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (3, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    weights = quality.fit(docs, labels, F.lit(True), bits=12)
    texts = dict(plain)
    key = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    rows = Counter(i for i, _ in plain)
    examples = sorted((key("fit", i), label, quality.features(texts[i], 12).tobytes()) for i, label in {(i, i % 2) for i in range(20)} | {(3, 0)} for _ in range(rows[i]))
    z, n, bias = defaultdict(float), defaultdict(float), 1 << 12

    def weight(k):
        return 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for _, label, ids in examples:
            ids = np.frombuffer(ids, np.int32).tolist()
            x = {k: c * quality.SCALE / max(1, len(ids)) for k, c in Counter(ids).items()} | {bias: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                n[k] += g * g
    score = lambda t: 1 / (1 + math.exp(-(weight(bias) + (quality.SCALE / len(f) * sum(weight(k) for k in f.tolist()) if len(f := quality.features(t, 12)) else 0.0))))
    got = quality.score(docs.select("doc_id", "text"), weights).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 4)) for r in got) == sorted((i or -1, round(score(t), 4)) for i, t in plain)


# Byte-level BPE


def test_byte_bpe(docs, plain):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in plain:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    assert Counter(map(tuple, got)) == Counter(want)
    ours, rng = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN), random.Random(1)
    parts = ["a", "th", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "日本", "🙂", "12", "!", "'s", "aaaa", "\xa0"]
    for _ in range(5000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert ours.ids(s) == enc.encode_ordinary(s), s
    long = "".join(rng.choice("abcdefgh") for _ in range(5000)).encode()
    assert ours.join(ours.encode(long[:1777]), ours.encode(long[1777:])) == ours.encode(long) == enc.encode_ordinary(long.decode())
    assert ours.decode(ours.encode(long)) == long and ours.decode([]) == b""
    for n in (*range(20), 100, 187):
        assert byte_bpe.joined([bytes([65 + i]) for i in range(n)]) == bytes(range(65, 65 + n))


def test_caches_are_bounded():
    cache = packing.Cached(lambda k: k * 2, 100)
    for i in range(2000):
        assert cache[f"key{i}"] == f"key{i}" * 2 and len(cache) <= 100
    assert cache["x" * 65] == "x" * 130 and "x" * 65 not in cache


# Repeated windows


def removed(items, length, plain_items):
    first = {}
    for i, x in plain_items:
        for s in range(len(x) - length + 1):
            key = items(x, s)
            first[key] = min(first.get(key, math.inf), order(i))
    out = []
    for i, x in plain_items:
        gone = [False] * len(x)
        for s in range(len(x) - length + 1):
            if first[items(x, s)] < order(i):
                gone[s : s + length] = [True] * length
        out.append((i, x, gone))
    return out


def test_substring_dedup(docs, plain):
    words = [(i, t.encode().split()) for i, t in plain]
    want = Counter()
    for i, w, gone in removed(lambda x, s: tuple(x[s : s + 50]), 50, words):
        want[i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert Counter(rows(substring_dedup.remove_repeats(docs))) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_BYTES, 4096, 64])
def test_suffix_dedup(docs, plain, limit):
    """With small limits, groups are split by further bytes, down to whole strings."""
    data = [(i, t.encode()) for i, t in plain]
    want = Counter()
    for i, b, gone in removed(lambda x, s: x[s : s + 50], 50, data):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    assert Counter(rows(suffix_dedup.remove_repeats(docs, group_bytes=limit))) == want


def test_suffix_dedup_keeps_columns(docs):
    got = suffix_dedup.remove_repeats(docs, rewrite=True)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == docs.count()
    keep = [c for c in docs.columns if c != "text"]
    assert Counter(rows(got.select(*keep))) == Counter(rows(docs.select(*keep)))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"abc", bytes(range(256))])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        joined = [x for i, t in enumerate(texts) for x in [*((1, c) for c in t), (0, i)]]
        t = np.array([c + 1 if kind else 0 for kind, c in joined], np.int16)
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(joined)), key=lambda p: joined[p:])


def test_merged_intervals():
    got = repeats.merge(np.array([[5, 9], [0, 3], [3, 4], [8, 12], [20, 21]]))
    assert got.tolist() == [[0, 4], [5, 12], [20, 21]]


# Links


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = rows(components.components(spark.createDataFrame(edges, "a long, b long")))
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in parent}


def links_of(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                count[i] += 1
                count[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: (order(ids[k]), k))] = min(a, b, key=lambda k: (order(ids[k]), k))
    return count, [ids[find(i)] for i in range(len(ids))]


def test_jaccard_join(docs, plain):
    sets = []
    for _, t in plain:
        w = t.encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    same = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ids = [i for i, _ in plain]
    count, reached = links_of(ids, same)
    got = jaccard_join.join(docs)
    assert Counter((r["doc_id"], r["n_links"], r["component_id"]) for r in got.collect()) == Counter(zip(ids, count, reached, strict=True))
    heads = got.groupBy("component_id").agg(F.sum(F.col("kept").cast("int"))).collect()
    assert all(r[1] == 1 for r in heads)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_tiles_and_intersections(docs, monkeypatch):
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randint(0, 60) for _ in range(rng.randint(0, 40))], np.uint64) << np.uint64(20)) for _ in range(40)]
    packed = [jaccard_join._pack(s) for s in sets]
    assert all((jaccard_join._unpack(p) == s >> np.uint64(16)).all() for p, s in zip(packed, sets, strict=True))
    for left, right in ((packed, packed), (packed[:15], packed[15:])):
        a, b, both = jaccard_join.intersections(left, right)
        x, y = (sets, sets) if left is right else (sets[:15], sets[15:])
        assert all(both[i, j] == len(np.intersect1d(p, q)) for i, p in enumerate(x) for j, q in enumerate(y) if left is not right or i != j)
    from querysmith.llm import pairs

    whole = Counter(rows(jaccard_join.join(docs).drop("rid")))
    monkeypatch.setattr(pairs.linked, "__defaults__", (2,))  # tiles of two classes
    assert Counter(rows(jaccard_join.join(docs).drop("rid"))) == whole
    for place in (0, 10**9):  # what a group costs decides lengths of prefixes, not results
        monkeypatch.setattr(jaccard_join, "PLACE", place)
        assert Counter(rows(jaccard_join.join(docs, depths=(6, 4, 2)).drop("rid"))) == whole
    numbered = docs.withColumn("no", F.monotonically_increasing_id() + 5)
    assert {r["rid"] for r in jaccard_join.join(numbered, row_col="no").collect()} == {r["no"] for r in numbered.collect()}


def test_every_prefix_length_reaches_the_recall():
    forest = jaccard_join.Forest()
    for depth, trees in zip(forest.depths, forest.trees, strict=True):
        assert 1 - (1 - 0.8**depth) ** trees >= jaccard_join.RECALL > 1 - (1 - 0.8**depth) ** (trees - 1)
    hashes = np.arange(50, dtype=np.uint64) * np.uint64(repeats.BASE)
    assert len(set(forest.prefixes(hashes).tolist())) == len(forest.level) == sum(forest.trees)


def test_crowded_texts_take_longer_prefixes(spark):
    """One shared short prefix of many unlike texts makes longer prefixes cheaper; near copies gain nothing by them."""
    forest, rng = jaccard_join.Forest(), random.Random(11)
    rows_ = []
    for k in range(400):
        for n in range(len(forest.level)):
            level = int(forest.level[n])
            copy = k < 200
            rows_.append((f"{'c' if copy else 'u'}{k}", n, n if copy or level == 0 else rng.randrange(1 << 40) + 1000))
    levels = jaccard_join.chosen_levels(spark.createDataFrame(rows_, "key string, n int, h long"), forest, len(rows_))
    # All 400 meet at the shortest prefix; only the 200 copies go on together, for which 18 groups of 200 cost more than 10 of 400.
    got = {r["key"]: r["level"] for r in levels.collect()}
    assert all(got[f"u{k}"] == 1 for k in range(200, 400)) and all(got[f"c{k}"] == 0 for k in range(200))


def test_word_hashes():
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"ab \n\t\xc3c") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [b"", b" ", b"x" * 600, b"y" * 600 + b" x"]
    values, counts = repeats.word_hashes(b"".join(texts), np.cumsum([len(t) for t in texts]).tolist())
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(values) == len(words)
    seen = {}
    assert all(seen.setdefault(w, v) == v for w, v in zip(words, values.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    for t in texts:
        assert repeats.word_hashes(t)[0].tolist() == [seen[w] for w in t.split()]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1), (7777, -2)], "k long, i long")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(3000)], "k long, v string")
    got = Counter(rows(base.hot_join(left, right, "k", 3002, how, plain=0).select("k", "i", "v")))
    assert got == Counter(rows(left.join(right, "k", how).select("k", "i", "v")))


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    near = base[:40] + 0.12 * rng.standard_normal((40, 16))
    vectors = [*base.tolist(), *near.tolist(), base[0].tolist(), (base[1] * 7).tolist(), None, [], [0.0] * 16, [math.nan] * 16, [math.inf] * 16, [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v, 1) for i, v in enumerate(vectors)] + [(None, base[5].tolist(), 1)]
    ids, values = [r[0] for r in table], [r[1] for r in table]

    def linked(i, j):
        x, y = (embedding_dedup.usable(values[k]) for k in (i, j))
        return x is not None and y is not None and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= 0.9

    count, reached = links_of(ids, linked)
    got = embedding_dedup.link(spark.createDataFrame(table, "vec_id long, embedding array<double>, id int")).collect()
    found, all_ = sum(r["n_links"] for r in got), sum(count)
    assert all_ >= found >= 0.97 * all_
    if found == all_:
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter(zip(ids, count, reached, strict=True))
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_calibration():
    for n in (100, 10_000, 10**6, 10**9, 10**12):  # no cap on lines at any size
        signs, lines, width = embedding_dedup.calibrate(n)
        p = (1 - math.acos(0.9) / math.pi) ** signs * math.erf(width / (2 * math.sin(math.acos(0.9) / 2)) / math.sqrt(2))
        assert 1 - (1 - p) ** lines - lines * p * (1 - p) ** (lines - 1) >= embedding_dedup.RECALL


def test_projections_do_not_depend_on_batches():
    x = np.random.default_rng(4).standard_normal((300, 64))
    stretch, value = embedding_dedup.coordinates(x, 7, 5)
    for i in (0, 17, 299):
        one = embedding_dedup.coordinates(x[i : i + 1], 7, 5)
        assert (one[0][0] == stretch[i]).all() and (one[1][0] == value[i]).all()
    assert abs(value.std() - 1) < 0.1


def test_collisions_reach_the_recall(spark):
    """Pairs at just over the least cosine among other vectors, with windows as small as those of many rows."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((1500, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * side
    signs, lines, width = embedding_dedup.calibrate(200_000)
    (sx, vx), (sy, vy) = (embedding_dedup.coordinates(v, lines, signs) for v in (a, b))
    met = ((sx == sy) & (np.abs(vx - vy) <= width)).sum(1)
    assert (met >= embedding_dedup.COLLISIONS).mean() >= 0.99


def test_planted_pairs_are_linked(spark):
    """End to end on 10,000 vectors: 3,000 pairs at cosines of 0.90 to 0.92, and nothing else that is near."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a = unit(rng.standard_normal((3000, 64)))
    side = rng.standard_normal((3000, 64))
    side = unit(side - (side * a).sum(1)[:, None] * a)
    cosine = rng.uniform(0.9001, 0.92, 3000)[:, None]
    vectors = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * side, unit(rng.standard_normal((4000, 64)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(df).collect()}
    linked = sum(got[3000 + i] == (1, i) and got[i] == (1, i) for i in range(3000))
    assert linked >= 0.99 * 3000
    assert all(got[i] == (0, i) for i in range(6000, 10_000)) and sum(n for n, _ in got.values()) == 2 * linked


# Pipeline


def test_pipeline(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, tiny)
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            kept = {r["doc_id"] for r in now.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) / len(good) > 0.97
        if name == "jaccard_join":
            heads = {r["doc_id"] for r in jaccard_join.join(before).filter("kept").collect()}
            assert {r["doc_id"] for r in now.collect()} == heads
        if name == "suffix_dedup":
            data = sorted((r["doc_id"], (r["text"] or "").encode()) for r in before.collect())
            want = {i: bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") for i, b, gone in removed(lambda x, s: x[s : s + 50], 50, data)}
            assert {r["doc_id"]: r["text"] for r in now.collect()} == want
        assert name == "packing" or (now.columns == names and now.dtypes == docs.dtypes)
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tiny).count() == 0, name
