"""Execution of stored queries, datasets, files, streams, the entry module."""

import json
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from querysmith.operators import collections
from querysmith.plans import dataset, execute, predict, steps, workload
from querysmith.sources import catalog, files
from querysmith.streaming import rollups


def test_limits_and_status(spark):
    assert execute.limited(spark, lambda: spark.sql("SELECT 1").count(), 60).value == 1
    assert execute.limited(spark, lambda: spark.sql("SELECT nope"), 60).status == "error"
    start = time.time()
    slow = "SELECT count(*) FROM range(0, 100000000000) WHERE pmod(hash(id), 7) = 8"
    assert execute.limited(spark, lambda: spark.sql(slow).collect(), 1.0).status == "timeout" and time.time() - start < 20
    found = execute.each(spark, ["SELECT 1", "SELECT 1", "SELECT * FROM nowhere"], lambda df: df.count(), 60)
    assert len(found) == 2 and found["SELECT * FROM nowhere"].status == "error"


def test_refinement(spark):
    broken = spark.createDataFrame([(1, "SELECT (1 + 2"), (2, "SELECT 1"), (3, "SELECT nothing FROM nowhere")], "q int, s string")
    got = {r["q"]: (r["status"], r["rounds"]) for r in execute.refine(spark, broken, "q", "s", 2).collect()}
    assert got[1] == ("ok", 1) and got[2] == ("ok", 0) and got[3][0] == "error"


def test_clean_and_build(spark, tiny, tmp_path):
    catalog.Database.at(spark, tiny, ["customer", "nation", "part", "orders", "supplier", "lineitem", "events"]).register()
    samples = workload.questions(spark).select(F.col("qid").alias("idx"), "question", F.col("gold").alias("SQL"), "db_id", "evidence", "difficulty")
    bad = spark.createDataFrame([(90, "q", "SELECT nope", "sales", "", "simple"), (91, "", "SELECT 1", "sales", "", "simple"), (92, "q", "SELECT 1 WHERE false", "sales", "", "simple")], samples.schema)
    kept = dataset.clean(samples.unionByName(bad), str(tmp_path / "clean"))
    ids = {r["idx"] for r in kept.collect()}
    assert ids and not ids & {90, 91, 92}
    again = dataset.clean(samples.limit(0), str(tmp_path / "clean"))  # resumes
    assert {r["idx"] for r in again.collect()} == ids
    out = dataset.build(kept.unionByName(kept).withColumn("schema_text", F.lit("T")), str(tmp_path / "data"))
    train, val = out["train"].count(), out["val"].count()
    assert val == max(1, int((train + val) * 0.05)) and out["train"].select("key").distinct().count() == train
    lines = spark.read.text(str(tmp_path / "data/train")).collect()
    assert all(len(json.loads(x[0])["messages"]) >= 2 for x in lines) and len(lines) == train


def test_every_question_is_mutated(spark, tiny, monkeypatch):
    seen = []
    monkeypatch.setattr(execute, "mutated", lambda s, samples, *a: seen.append({r["qid"] for r in samples.collect()}) or samples.selectExpr("qid", "'' AS error_type"))
    assert __spark_entry__.queries()["verified_mutations"](spark, tiny).count() == len(workload.QUESTIONS)
    assert seen == [{q[0] for q in workload.QUESTIONS}]


def test_no_question_is_lost_to_a_time_limit(spark, tiny, monkeypatch):
    # Tables so large that no query ends within a limit: registered queries wait, and mutations run each query once.
    limited, ran, each = execute.limited, [], execute.each
    catalog.Database.at(spark, tiny, ["customer", "nation", "part", "orders", "supplier", "lineitem", "events"]).register()
    want = {r["qid"] for r in execute.mutated(spark, workload.questions(spark), "qid", "gold", 600.0).collect()}
    monkeypatch.setattr(execute, "limited", lambda s, work, seconds: limited(s, work, None) if seconds is None else execute.Outcome("timeout"))

    def counted(s, queries, *a):
        asked = list(dict.fromkeys(queries))
        ran.extend(asked)
        return each(s, asked, *a)

    monkeypatch.setattr(execute, "each", counted)
    found = {r["qid"] for r in __spark_entry__.queries()["verified_mutations"](spark, tiny).collect()}
    assert found == want and len(want) > 5 and len(ran) == len(set(ran))
    for name in ("exec_validation", "result_previews", "refined_queries"):
        assert not __spark_entry__.queries()[name](spark, tiny).filter("status = 'timeout'").count()
    assert not __spark_entry__.queries()["result_compare"](spark, tiny).filter("pred_status = 'timeout'").count()


def test_two_failed_queries_are_not_right(spark):
    pairs = spark.createDataFrame([(1, "SELECT nope", "SELECT nope2"), (2, "SELECT 1", "SELECT nope"), (3, "SELECT 1.00001", "SELECT 1"), (4, "SELECT 2", "SELECT 1")], "idx int, pred_sql string, gold_sql string")
    got = {r["idx"]: (r["pred_status"], r["gold_status"], r["correct"]) for r in execute.judged(spark, pairs).collect()}
    assert got == {1: ("error", "error", False), 2: ("ok", "error", False), 3: ("ok", "ok", True), 4: ("ok", "ok", False)}


def test_pages_hold_a_bounded_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(execute, "PAGE", 3)
    assert [len(p) for p in execute.pages(spark.range(8).repartition(1))] == [3, 3, 2]
    got = execute.validated(spark, spark.range(8).selectExpr("id", "concat('SELECT ', id) AS q"), "q", "id")
    assert got.count() == 8 and got.filter("status = 'ok' AND n_rows = 1").count() == 8


def test_predictions(spark):
    asked = spark.createDataFrame([(1, "How many?", "d", None), (2, "", "d", None), (3, "Which one?", "d", "hint")], "qid int, question string, db_id string, evidence string")

    def good(q):
        return q.select("qid", F.when(F.col("qid") == 1, F.concat(F.lit("```sql\nSELECT "), F.length("prompt").cast("string"), F.lit("\n```"))).alias("reply"))

    def fails(q):
        raise RuntimeError("no model")

    made = predict.Predictor(spark, [fails, good], method="self_consistency")
    got = {r["qid"]: r for r in made.predict_batch(asked).collect()}
    assert got[1]["sql"].startswith("SELECT ") and got[1]["selected_method"] == "single" and got[1]["runs"]
    assert (got[2]["sql"], got[2]["selected_method"], got[2]["candidates"]) == (predict.NOTHING, "error", [])
    assert got[3]["candidates"] == [predict.NOTHING] and set(predict.STAGES) < set(made.timing)
    one = predict.Predictor(spark, [good, lambda q: q.select("qid", F.lit("SELECT 5").alias("reply"))]).predict("How many?", "d")
    assert len(one["candidates"]) == 1 and one["time_seconds"] >= 0


def test_steps(spark, tiny, tmp_path, capsys):
    root = tmp_path / "dbs/sales"
    for t in ("region", "nation"):
        spark.read.parquet(f"{tiny}/{t}.parquet").write.parquet(str(root / f"{t}.parquet"))
    config = {"root": str(tmp_path / "dbs"), "out": str(tmp_path / "schemas")}
    calls = []

    def describe(rows):
        calls.append(rows.count())
        return rows.select("key", F.concat(F.lit("about "), "column").alias("description"))

    assert steps.prepare_schemas(spark, config, describe) == {"sales": "made"} and steps.prepare_schemas(spark, config, describe) == {"sales": "there"}
    assert calls == [5] and "about n_name" in steps.schemas(spark, config["out"]).first()["schema_text"]
    pairs = [{"idx": 1, "pred_sql": "SELECT count(*) FROM region", "gold_sql": "SELECT 5", "difficulty": "simple", "db_id": "sales", "question": "q"}, {"idx": 2, "pred_sql": "SELEC", "gold_sql": "SELECT 5", "difficulty": "simple", "db_id": "sales", "question": "q"}]
    (tmp_path / "pairs.json").write_text("\n".join(map(json.dumps, pairs)))
    evaluation = {"root": str(root), "pairs": str(tmp_path / "pairs.json"), "out": str(tmp_path / "eval")}
    took = steps.run(spark, config | {"evaluate": evaluation}, "evaluate", ("prepare-schemas", "evaluate"))
    assert [n for n, _ in took] == ["evaluate"]
    result = json.loads(spark.read.text(evaluation["out"] + "/eval_results").first()[0])
    assert result["overall"]["correct"] == 1 and result["error_analysis"]["syntax_error"]["count"] == 1
    report = "\n".join(r[0] for r in spark.read.text(evaluation["out"] + "/report").collect())
    assert "Execution accuracy: 0.5000" in report and "`SELEC`" in report
    with pytest.raises(ValueError):
        steps.run(spark, config, "nowhere")
    assert set(steps.check_setup(spark, config | {"samples": str(tmp_path), "memory_gb": 80}).values()) == {True}


def test_collections(spark, tmp_path):
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    folder = str(tmp_path / "store")
    tables = {"t": spark.createDataFrame([("aa", 1), (" bbb ", 2), ("aa", None)], "s string, n int")}
    cache = {}
    built = collections.ensure(spark, folder, lambda: collections.cells(tables, embed), cache)
    assert sorted(r["document"] for r in built.collect()) == ["1", "2", "aa", "bbb"]
    assert collections.ensure(spark, folder, lambda: 1 / 0, cache) is built and collections.ensure(spark, folder, lambda: 1 / 0).count() == 4
    assert collections.ensure(spark, str(tmp_path / "none"), lambda: None) is None
    collections.append(collections.cells(tables, embed), folder)
    assert collections.stored(spark, folder).count() == 4
    asked = spark.createDataFrame([(1, "xxx")], "qid int, text string")
    assert collections.hits(built, asked, embed, 1).first()["distance"] < 1e-9


def test_files(spark, tmp_path):
    array, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    array.write_text(json.dumps([{"question": "q", "SQL": "s", "db_id": "d"}, {"question": "", "SQL": "s", "db_id": "d"}]))
    lines.write_text('{"question": "q"}\n\n{"question": "p"}\n')
    assert files.usable(files.read_array(spark, str(array))).count() == 1
    assert files.read_lines(spark, str(lines)).count() == 2
    with pytest.raises(ValueError):
        files.read_array(spark, str(lines))
    assert files.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}, "d": 1}
    (tmp_path / "clean").mkdir()
    (tmp_path / "clean/x.jsonl").write_text('{"question": " q ", "sql": "s", "db_id": "d"}\n{"question": " ", "sql": "s", "db_id": "d"}\n')
    assert [tuple(r) for r in files.first_examples(spark, str(tmp_path / "clean")).collect()] == [("q", "s", "d", "")]
    assert files.first_examples(spark, str(tmp_path / "nothing"), str(array)).count() == 1
    stage = tmp_path / "stage/one"
    spark.range(3).write.parquet(str(stage))
    assert files.resume(spark, str(tmp_path / "stage"), "one").count() == 3
    for part in stage.glob("*.parquet"):
        part.write_bytes(b"broken")
    for crc in stage.glob(".*.crc"):
        crc.unlink()
    assert files.resume(spark, str(tmp_path / "stage"), "one") is None
    assert files.first_filled([lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.range(2)]).count() == 2


def test_places(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "dev/databases/shop/t.parquet"))
    assert catalog.resolve(spark, str(tmp_path), "shop").endswith("dev/databases/shop")
    assert catalog.resolve(spark, str(tmp_path), "other") is None


def test_stream_equals_batch(spark, tiny, tmp_path):
    e = spark.read.parquet(f"{tiny}/events.parquet").select("ts", "user_id", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = rollups.windowed(rollups.read(spark, str(tmp_path / "in"), e._jdf.schema().toDDL()), "ts", "user_id", "value", "1 day", "0 seconds")
    rollups.drained(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = rollups.windowed(e, "ts", "user_id", "value", "1 day")
    key = ["start", "user_id", "n"]
    assert got.count() and got.select(*key).exceptAll(whole.select(*key)).isEmpty()


def test_every_query_has_rows_or_a_schema(spark, tiny):
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0
    for name in ("row_counts", "schema_light", "sql_components", "word_length_stats", "sql_window_rank"):
        assert found[name](spark, tiny).columns
