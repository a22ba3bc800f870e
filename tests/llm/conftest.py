import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies, shared passages, and columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = make(80), make(200)
    texts = [make(rng.randint(1, 150)) for _ in range(20)]
    texts += [f"{make(30)} {shared} {make(20)}" for _ in range(4)]
    words = base.split()
    for i in range(4):
        near = list(words)
        near[50 + i] = f"changed{i}"
        texts.append(" ".join(near))
    texts += [base, base, "", None, "   ", "one two", "one two", make(6000), "Ünïcode 日本語 🙂\n\n  x", "a" * 3000, texts[0]]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "en", 1, 2.0, "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all here", "s1", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rid int, score double, key string")


@pytest.fixture(scope="session")
def plain(docs):
    """Collected (doc_id, text) pairs; a null text is empty."""
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
