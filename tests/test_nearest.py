"""Top-k searches against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysmith.operators import lsh, nearest, vectors


def all_pairs(entries, queries, k, labels=None):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = set()
    for qid, q, *ql in queries:
        if not usable(q):
            continue
        found = []
        for i, v, *el in entries:
            if usable(v) and len(v) == len(q) and i != qid and (labels is None or ql == el and ql[0] is not None):
                x, y = np.array(q), np.array(v)
                found.append((round(1 - float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)), 6), i))
        out |= {(qid, i, d, r) for r, (d, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8)) * 3
    out = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.standard_normal(8)], i % 4) for i in range(1200)]
    out += [(3000 + i, out[5][1], 1) for i in range(600)]  # a third are copies with one label
    out += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 8, 1), (4003, [math.nan] * 8, 1), (4004, [1.0, 2.0], 1), (4005, [2.0, 1.0], 1), (4006, [1e200, 1.0], 2), (4007, [1.0] * 8, None)]
    return out


def got(df):
    return {(r["qid"], r["id"], round(r["distance"], 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("centres", "block"), [(256, 16_384), (16, 50), (1, 100)])
def test_cosine_search(spark, rows, centres, block):
    entries = spark.createDataFrame(rows, "id long, v array<double>, label int").drop("label")
    asked = [r[:2] for r in rows if r[0] % 40 == 0 or r[0] > 3990]
    report = {}
    found = nearest.search(entries, spark.createDataFrame(asked, "qid long, q array<double>"), 4, centres=centres, block=block, report=report)
    assert got(found) == all_pairs([r[:2] for r in rows], asked, 4)
    assert report["met"] <= report["all"] and (centres == 1 or report["met"] < 0.5 * report["all"])
    assert found.columns == ["qid", "id", "distance", "rank"]


def test_cosine_search_by_label(spark, rows):
    entries = spark.createDataFrame(rows, "id long, v array<double>, label int")
    asked = [r for r in rows if r[0] % 50 == 0 or r[0] > 3990] + [(9000, rows[0][1], 77)]
    queries = spark.createDataFrame(asked, "qid long, q array<double>, label int")
    assert got(nearest.search(entries, queries, 3, "label", block=64)) == all_pairs(rows, asked, 3, labels=True)
    # A label without entries is searched everywhere.
    anywhere = got(vectors.top_k_or_any(entries, queries, 3, "label"))
    assert {r for r in anywhere if r[0] == 9000} == all_pairs([r[:2] for r in rows], [(9000, rows[0][1])], 3)


def test_cosine_search_with_text_ids_and_no_rows(spark, rows):
    named = [(f"e{i}", v) for i, v, _ in rows[:200]]
    asked = [(7, rows[7][1])]
    found = nearest.search(spark.createDataFrame(named, "id string, v array<float>"), spark.createDataFrame(asked, "qid int, q array<float>"), 5)
    assert {(r[0], r[1]) for r in got(found)} == {(str(q), i) for q, i, *_ in all_pairs(named, [("7", rows[7][1])], 5)}
    empty = spark.createDataFrame([], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "qid long, q array<double>")
    assert nearest.search(empty, asked, 3).count() == 0 and nearest.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>"), asked.limit(0), 3).count() == 0
    assert got(nearest.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>"), asked, 3)) == {(1, 2, 0.0, 1)}


@pytest.mark.parametrize("crowded", [4096, 20, 0])
def test_look_up_by_postings(spark, crowded):
    rng = random.Random(1)
    texts = sorted({" ".join(rng.choice(["steel", "large", "ring", "bolt", "hot", "plate", "x", "qq"]) for _ in range(rng.randint(1, 4))) for _ in range(200)})
    entries = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("signature", lsh.signature(F.col("value")))
    other = spark.createDataFrame([("zzzz nothing",), (None,)], "value string").withColumn("signature", lsh.signature(F.col("value")))
    queries = entries.filter("hash(value) % 6 = 0").unionByName(other).select(F.col("value").alias("qid"), "signature")
    signed = {r[0]: r[1] for r in entries.collect()}
    want = set()
    for qid, s in queries.collect():
        if s is not None and qid is not None:
            best = sorted((-round(sum(a == b for a, b in zip(s, t, strict=True)) / 100, 4), v) for v, t in signed.items())[:5]
            want |= {(qid, v, -x, i) for i, (x, v) in enumerate(best, 1)}
    found = lsh.look_up(entries, queries.filter("qid IS NOT NULL"), 5, crowded=crowded, salts=3)
    assert {tuple(r) for r in found.select("qid", "value", "similarity", "rank").collect()} == want
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
