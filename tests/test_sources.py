"""Places of databases and of dev samples, links as text, readers and steps that use them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from querysmith.functions import mutations, schema_text, text
from querysmith.plans import steps
from querysmith.sources import catalog, files


@pytest.mark.parametrize("layout", catalog.LAYOUTS)
def test_every_layout_is_found(spark, tmp_path, layout):
    place = f"{tmp_path}/{layout.format(id='shop')}"
    spark.range(3).write.parquet(f"{place}/t.parquet")
    assert catalog.resolve(spark, str(tmp_path), "shop").removeprefix("file:") == place
    assert catalog.resolve(spark, f"{tmp_path}/none", "shop", str(tmp_path)).removeprefix("file:") == place
    assert catalog.resolve(spark, str(tmp_path), "sho") is None


def test_first_layouts_win(spark, tmp_path):
    for place in ("shop", "dev/shop", "train/shop"):
        spark.range(1).write.parquet(f"{tmp_path}/{place}/t.parquet")
    assert catalog.resolve(spark, str(tmp_path), "shop").endswith("/train/shop")


def test_dev_samples(spark, tmp_path):
    rows = [{"question": f"q{i}", "SQL": "SELECT 1", "db_id": "d", "evidence": "", "difficulty": "simple"} for i in (2, 1, 3)]
    os.mkdir(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        files.dev_samples(spark, str(tmp_path / "none"))
    (tmp_path / "a" / "questions.json").write_text(json.dumps(rows[:1]))
    assert files.dev_samples(spark, str(tmp_path / "a")).count() == 1
    (tmp_path / "a" / "dev.json").write_text(json.dumps(rows))
    got = files.dev_samples(spark, str(tmp_path / "a")).orderBy("idx").collect()
    assert [(r["idx"], r["question"]) for r in got] == [(0, "q2"), (1, "q1"), (2, "q3")]
    assert files.dev_samples(spark, str(tmp_path / "a" / "questions.json")).count() == 1


def test_predictions_for_dev_samples(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/db/t.parquet")
    (tmp_path / "dev.json").write_text(json.dumps([{"question": "How many are there?", "SQL": "SELECT COUNT(*) FROM t", "db_id": "db", "evidence": ""}]))
    out = steps.predict_all(spark, {"root": f"{tmp_path}/db", "dev": str(tmp_path), "out": f"{tmp_path}/out"}, [lambda q: q.select("qid", F.lit("```sql\nSELECT COUNT(*) FROM t\n```").alias("reply"))])
    assert [(r["qid"], r["sql"], r["runs"]) for r in out.collect()] == [(0, "SELECT COUNT(*) FROM t", True)]
    assert files.read_lines(spark, f"{tmp_path}/out/predictions", "qid long, sql string").count() == 1


def test_links_by_table(spark):
    links = spark.createDataFrame([("b", "x", "c", "y", 1), ("a", "k", "c", "y", 0), ("b", "w", "a", "k", 2)], catalog.LINKS)
    assert schema_text.link_comments(links).first()[0] == "\n-- Foreign Keys:\n-- a.k -> c.y\n-- b.x -> c.y\n-- b.w -> a.k"


def test_clause_mutations():
    assert mutations.turned_order("SELECT a FROM t ORDER BY a, b ASC LIMIT 1") == "SELECT a FROM t ORDER BY a, b DESC LIMIT 1"
    assert mutations.turned_order("SELECT a FROM t ORDER BY a NULLS LAST") == "SELECT a FROM t ORDER BY a DESC NULLS LAST"
    assert mutations.turned_order("SELECT 'ORDER BY a' FROM t") is None and mutations.turned_order(None) is None
    assert mutations.less_conditions("SELECT a FROM t WHERE a BETWEEN 1 AND 2 AND b = 'x AND y' GROUP BY a") == "SELECT a FROM t WHERE a BETWEEN 1 AND 2 GROUP BY a"
    assert mutations.less_conditions("SELECT a FROM t WHERE a BETWEEN 1 AND 2;") == "SELECT a FROM t;" and mutations.less_conditions("SELECT 'WHERE x'") is None
    three = "SELECT t.a, u.b FROM tab t JOIN uab u ON t.x = u.y JOIN w v ON v.a = t.a WHERE 't.x' = u.z"
    assert mutations.other_aliases(three) == "SELECT u.a, t.b FROM tab t JOIN uab u ON u.x = t.y JOIN w v ON v.a = u.a WHERE 't.x' = t.z"
    assert mutations.other_aliases("SELECT a.x FROM tab a") is None and mutations.other_aliases("SELECT x FROM tab a, other b") is None


def test_question_skeletons(spark):
    cases = {
        "Was 'Bob' born on 2021-01-15 or 01/15/2021, 3.5 or 7 times in room12?": "Was <STRING> born on <DATE> or <DATE>, <NUMBER> or <NUMBER> times in room12?", "It''s \"quoted' 5": "It'<STRING>quoted' <NUMBER>",
        "1-2-2021-1-2 é5 x_1 4.": "<NUMBER>-<NUMBER>-<DATE> é5 x_1 <NUMBER>.", "": "", "no 'end": "no 'end",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "q string")
    got = {r[0]: r[1] for r in df.select("q", text.question_skeleton(F.col("q"))).collect()}
    assert got == cases | {None: None}
