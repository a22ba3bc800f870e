"""Stores with commits, and searches of stored collections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysmith.operators import collections
from querysmith.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_generations(spark, tmp_path):
    folder = str(tmp_path / "s")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert store.newest(spark, folder) is None and store.rows(spark, folder) is None
    first = store.add(frame(("a", 1), ("a", 1), ("b", 2), (None, 3)), folder, "k")
    assert first.number == 1 and rows(store.rows(spark, folder)) == [("a", 1), ("b", 2)]
    assert store.add(frame(("a", 9)), folder, "k") == first  # nothing new, nothing committed
    second = store.add(frame(("a", 9), ("c", 3)), folder, "k")
    assert second.number == 2 and rows(store.rows(spark, folder)) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(store.rows(spark, folder, first)) == [("a", 1), ("b", 2)]  # a reader keeps its generation


def test_interleaved_runs_commit_each_key_once(spark, tmp_path):
    folder = str(tmp_path / "s")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    later = iter([lambda: store.add(frame(("b", 20), ("c", 30)), folder, "k"), lambda: store.add(frame(("d", 40)), folder, "k")])
    made = store.add(frame(("a", 1), ("b", 2), ("d", 4)), folder, "k", before=lambda: next(later, lambda: None)())
    assert made.number == 3 and rows(store.rows(spark, folder)) == [("a", 1), ("b", 20), ("c", 30), ("d", 40)]
    # All that a run wanted to add may be there by then.
    later = iter([lambda: store.add(frame(("e", 5)), folder, "k")])
    assert store.add(frame(("e", 6)), folder, "k", before=lambda: next(later, lambda: None)()).number == 4
    assert dict(rows(store.rows(spark, folder)))["e"] == 5
    assert store.swept(spark, folder, older_seconds=-1) >= 1 and len(rows(store.rows(spark, folder))) == 5


def test_answers(spark, tmp_path):
    folder, asked = str(tmp_path / "s"), []

    def answer(df):
        asked.append(sorted(r["key"] for r in df.collect()))
        return df.withColumn("reply", F.concat(F.lit("re "), "key"))

    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, key string")
    got = store.answered(wanted.filter("id < 2"), folder, "key", answer)
    assert rows(got.select("id", "key", "reply")) == [(1, "a", "re a")]
    assert rows(store.answered(wanted, folder, "key", answer).select("id", "key", "reply")) == [(1, "a", "re a"), (2, "b", "re b"), (3, "a", "re a")]
    assert asked == [["a"], ["b"]]
    later = iter([lambda: store.answered(spark.createDataFrame([(9, "z")], "id int, key string"), folder, "key", lambda df: df.withColumn("reply", F.lit("first")))])
    slow = store.answered(spark.createDataFrame([(8, "z"), (7, "y")], "id int, key string"), folder, "key", answer, before=lambda: next(later, lambda: None)())
    assert rows(slow.select("id", "key", "reply")) == [(7, "y", "re y"), (8, "z", "first")]
    empty = str(tmp_path / "none")
    assert store.answered(wanted.limit(0), empty, "key", lambda df: df.withColumn("reply", F.lit("x"))).columns == ["key", "id", "reply"]


@pytest.mark.parametrize("same", [True, False])
def test_stored_search(spark, tmp_path, same):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 6)) * 4
    data = [(f"e{i}", [float(x) for x in centres[i % 8] + 0.2 * rng.standard_normal(6)], f"{i % 3}") for i in range(900)] + [("zero", [0.0] * 6, "1"), ("none", None, "1"), ("other", [1.0, 2.0], "1"), ("null", [1.0] * 6, None)]
    df = spark.createDataFrame(data, "id string, v array<double>, db_id string")
    folder = str(tmp_path / "c")
    collections.append(df.filter("length(id) < 5"), folder, by="db_id", batch=40)
    collections.append(df, folder, by="db_id", batch=40)
    found = collections.stored(spark, folder)
    assert found.count() == len(data) - 2 and found.select("id").distinct().count() == len(data) - 2 and dict(found.dtypes)["part"] == "string"
    asked = [(i, v, p) for i, v, p in data if i in ("e3", "e77", "e400", "zero", "null")]
    report = {}
    got = collections.search(spark, folder, spark.createDataFrame(asked, "qid string, q array<double>, part string"), 4, same=same, report=report)
    want = set()
    for qid, q, p in asked:
        if any(q):
            scored = sorted((round(1 - float(np.dot(q, v)) / math.sqrt(float(np.dot(q, q)) * float(np.dot(v, v))), 6), i) for i, v, part in data if v and any(v) and len(v) == len(q) and i != qid and (part == p or not same))
            want |= {(qid, i, d, r) for r, (d, i) in enumerate(scored[:4], 1)}
    assert {(r["qid"], r["id"], round(r["distance"], 6), r["rank"]) for r in got.collect()} == want
    assert report["met"] < 0.7 * report["all"]
    with pytest.raises(ValueError):
        collections.append(df, folder)
    assert collections.search(spark, str(tmp_path / "no"), spark.createDataFrame(asked, "qid string, q array<double>, part string"), 4) is None


def test_stored_search_reads_few_folders(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = np.eye(5) * 5
    data = [(i, [float(x) for x in centres[i % 5] + 0.1 * rng.standard_normal(5)], f"db{i % 4}") for i in range(1000)]
    folder = str(tmp_path / "c")
    collections.append(spark.createDataFrame(data, "id long, v array<double>, db_id string"), folder, by="db_id")
    at = store.newest(spark, folder)
    own = store.rows(spark, folder, at).select("id", "v", "part", "cell", F.lit("x").alias("group"), F.lit(0).alias("place"))
    found = collections.StoredSearch(own, None, None, None, 3, grouped=True)
    visits = spark.createDataFrame([("db1", 0), ("db1", 2), ("db3", 0)], "group string, cell int")
    few = found.entries_of(visits)
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    kept = {(r["part"], r["cell"]) for r in store.rows(spark, folder, at).select("part", "cell").distinct().collect()} & {("db1", 0), ("db1", 2), ("db3", 0)}
    assert few.count() == store.rows(spark, folder, at).filter("(part = 'db1' AND cell IN (0, 2)) OR (part = 'db3' AND cell = 0)").count()
    read = {f.split("/part-")[0].split("commit=")[1].split("/", 1)[1] for r in few.select(F.input_file_name()).distinct().collect() for f in r}
    assert read == {f"part={p}/cell={c}" for p, c in kept}
