"""Models as columns, judged repair, labels of chats, canonical texts, lines without keys, monitors over streams."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from querysmith import queries
from querysmith.functions import canonical, text, tokens
from querysmith.operators import reward
from querysmith.plans import dataset, models, predict, repair, training
from querysmith.sources import files
from querysmith.streaming import monitors, rollups

MESSAGES = "array<struct<role:string,content:string>>"
ODD = ["plain", 'quo"te \\ back', "line\n\r\ttab\b\f", "ctl \x00\x01\x1f\x7f", "é 日本 🙂", "", "a/b", " "]


def test_canonical_json(spark):
    rows = [(i, [("user", t), ("assistant", t + "x")], {"b": t, "a": None}, i % 2 == 0) for i, t in enumerate(ODD)] + [(99, None, None, None), (100, [], {}, True)]
    df = spark.createDataFrame(rows, f"id long, m {MESSAGES}, d map<string,string>, flag boolean")
    show = lambda c, only: canonical.written(F.col(c), df.schema[c].dataType, only)
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", show("m", True), show("m", False), show("d", True), show("flag", True), text.message_hash(F.col("m"))).collect()}
    for i, m, d, flag in rows:
        plain = None if m is None else [{"role": a, "content": b} for a, b in m]
        dump = lambda x, only: json.dumps(x, sort_keys=True, ensure_ascii=only)
        assert got[i] == (dump(plain, True), dump(plain, False), dump(d, True), dump(flag, True), hashlib.sha256(dump(plain, False).encode()).hexdigest())
    keys = df.select(text.cache_key(F.lit("é\n"), F.lit(None), F.lit("x"))).first()[0]
    assert keys == hashlib.sha256(json.dumps(["é\n", "", "x"]).encode()).hexdigest()
    with pytest.raises(TypeError):
        canonical.written(F.lit(1.5), spark.range(1).select(F.lit(1.5)).schema[0].dataType)


def test_lines_keep_the_order_of_their_files(spark, tmp_path):
    folder = tmp_path / "lines"
    os.mkdir(folder)
    rng = random.Random(3)
    want = []
    for name in ("b", "a", "c"):
        rows = [f'{{"v": "{name}{i} {"x" * rng.randint(0, 40)}"}}' for i in range(3000)]
        (folder / f"{name}.json").write_text("\n\n".join(rows) + "\n")
        want += [(name, r) for r in rows]
    want = [r for _, r in sorted(want, key=lambda x: x[0])]
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            got = dict(files.numbered_lines(spark, str(folder)).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
    # Two files that were written in an order join by the places of their lines.
    spark.range(500).select((F.lit(1000) - F.col("id")).alias("a")).orderBy("a").write.json(str(tmp_path / "l"))
    spark.range(500).select((F.col("id") * 2).alias("b")).orderBy("b").write.json(str(tmp_path / "r"))
    met = files.read_numbered(spark, str(tmp_path / "l"), "a long").join(files.read_numbered(spark, str(tmp_path / "r"), "b long"), "idx")
    assert sorted(map(tuple, met.collect())) == [(i, 501 + i, 2 * i) for i in range(500)]


def by_search(ids, header, end):
    labels = [-100] * len(ids)
    for i in range(len(ids) - len(header) + 1):
        if ids[i : i + len(header)] == header:
            start = i + len(header)
            stop = next((j + 1 for j in range(start, len(ids)) if ids[j] == end), len(ids))
            labels[start:stop] = ids[start:stop]
    return labels


def test_labels_of_conversations(spark, tiny):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    header, end = encode("<|im_start|>assistant\n"), encode("<|im_end|>")[0]
    chats = {r["conv_id"]: r["messages"] for r in queries._messages(spark, tiny).collect()}
    got = queries.QUERIES["assistant_labels"](spark, tiny).collect()
    assert {r["conv_id"] for r in got} == set(chats)
    longest = {}
    for r in got:
        ids = encode("".join(f"<|im_start|>{m['role']}\n{m['content'] or ''}<|im_end|>\n" for m in chats[r["conv_id"]]))[:2048]
        n = len(ids)
        assert r["ids"][:n] == ids and r["labels"][:n] == by_search(ids, header, end) and any(x != -100 for x in r["labels"]) == any(m["role"] == "assistant" for m in chats[r["conv_id"]])
        pad = len(r["ids"]) - n
        assert r["ids"][n:] == [50256] * pad and r["labels"][n:] == [-100] * pad and r["mask"] == [1] * n + [0] * pad
        longest.setdefault(r["batch"], []).append((n, len(r["ids"])))
    for rows in longest.values():
        assert len(rows) <= 8 and {w for _, w in rows} == {max(n for n, _ in rows)}
    # Spans in ids of any kind: none, overlapping headers, no end, fewer ids than the header has.
    cases = [[1, 2, 9, 1, 2, 5], [1, 2, 1, 2, 9, 9], [1], [], [1, 2], [9, 9], [7, 1, 2, 3, 4]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>")
    labels = df.select("i", text.masked_labels(F.col("ids"), text.turn_spans(F.col("ids"), [1, 2], 9)).alias("l"))
    assert [r["l"] for r in labels.orderBy("i").collect()] == [by_search(c, [1, 2], 9) for c in cases]


def test_token_ids_of_nulls(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i int, t string")
    assert [len(r[0]) for r in df.orderBy("i").select(tokens.token_ids(F.col("t"), public_tokenizers.path("byte_bpe_50k.json"))).collect()] == [2, 0, 0]


def test_encodings_of_a_batch_are_bounded(spark):
    # A batch of many and long texts is encoded in slices; order, nulls and cuts stay as they are.
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    sizes = [3, 200_000, 400_000, 0, 600_000, *[50] * 1500]
    whole = [None if i % 100 == 7 else ("word " * n)[:n] for i, n in enumerate(sizes)]
    parts = list(tokens.slices(t or "" for t in whole))
    assert [t for p in parts for t in p] == [t or "" for t in whole]
    assert all(len(p) <= 256 and (len(p) == 1 or sum(map(len, p)) <= 1 << 19) for p in parts) and list(tokens.slices([])) == []

    df = spark.createDataFrame(list(enumerate(whole)), "i int, t string").coalesce(1)
    got = {r["i"]: r["x"] for r in df.select("i", tokens.token_ids(F.col("t"), path, 20).alias("x")).collect()}
    want = tokens.ids_of([t or "" for t in whole], path)
    assert got == {i: x[:20] for i, x in enumerate(want)}
    assert df.limit(0).select(tokens.token_ids(F.col("t"), path)).collect() == []


def test_models_load_once_and_keep_failed_rows(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        open(f"{marks}/load-{os.getpid()}-{random.random()}", "w").close()

        def model(batch):
            open(f"{marks}/call-{random.random()}", "w").close()
            if any("bad" in t for t in batch):
                raise ValueError("bad text")
            if batch == ["short"]:
                return []
            return [t.upper() for t in batch]

        return model

    texts = [f"t{i}" for i in range(200)] + ["bad one", "short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    out = {r["i"]: (r["r"]["value"], r["r"]["error"]) for r in df.select("i", models.call(F.col("t"), f"m{marks}", load, tries=2, together=16, wait=0.0).alias("r")).collect()}
    assert all(out[i] == (f"T{i}", None) for i in range(200))
    assert out[200] == (None, "ValueError: bad text") and out[202] == (None, "no text") and out[201] == (None, "0 values for 1 texts")
    loads = [f for f in os.listdir(marks) if f.startswith("load")]
    assert len(loads) == len({f.split("-")[1] for f in loads})  # once a worker
    asked = spark.createDataFrame([(1, "p"), (2, "bad")], "qid int, prompt string")
    rows = {r["qid"]: (r["reply"], r["error"]) for r in models.generator(f"g{marks}", load, 1)(asked).collect()}
    assert rows == {1: ("P", None), 2: (None, "ValueError: bad text")}
    vectors = asked.select(models.embedder("lengths", lambda: lambda batch: [[float(len(t))] for t in batch])(F.col("prompt")).alias("v")).collect()
    assert sorted(r["v"] for r in vectors) == [[1.0], [3.0]]


def test_attempts_are_bounded():
    calls = []

    def model(batch):
        calls.append(list(batch))
        if len(calls) < 3:
            raise TimeoutError("later")
        return [len(t) for t in batch]

    assert models.called(model, ["abc"], tries=3, wait=0.0) == [(3, None)] and len(calls) == 3
    calls.clear()
    assert models.called(model, ["abc"], tries=2, wait=0.0) == [(None, "TimeoutError: later")] and len(calls) == 2
    assert models.called(model, [None]) == [(None, "no text")]


def test_failed_generators_are_named(spark, tiny):
    made = predict.Predictor(spark, [lambda q: 1 / 0, lambda q: q.select("qid", F.lit("SELECT 1").alias("reply"))])
    asked = spark.createDataFrame([(1, "how many?", "db", "")], "qid int, question string, db_id string, evidence string")
    assert made.predict_batch(asked).first()["sql"] == "SELECT 1;" and "division" in made.failures[0]


def test_predictions_with_values_and_a_judge(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").createOrReplaceTempView("named")
    prompts = []

    def generate(q):
        prompts.extend(r["prompt"] for r in q.collect())
        return q.select("qid", F.lit("```sql\nSELECT id FROM named WHERE name = 'b'\n```").alias("reply"))

    made = predict.Predictor(
        spark, [generate], values=lambda q: q.filter("qid = 1").select("qid", F.lit("- named.name: 'a'").alias("hints")),
        judge=lambda df: df.select("key", F.when(F.col("prompt").contains("'b'"), '{"valid": false, "confidence": 1, "reason": "not a"}').otherwise('{"valid": true, "confidence": 1}').alias("reply")),
        fix=lambda df: df.select("key", F.lit("```sql\nSELECT id FROM named WHERE name = 'a'\n```").alias("reply")),
    )
    asked = spark.createDataFrame([(1, "Which is a?", "db", ""), (2, "Which?", "db", "")], "qid int, question string, db_id string, evidence string")
    assert {r["qid"]: r["sql"] for r in made.predict_batch(asked).collect()} == dict.fromkeys((1, 2), "SELECT id FROM named WHERE name = 'a'")
    assert sorted("- named.name: 'a'" in p for p in prompts) == [False, True]


def test_judged_repair_asks_nothing_twice(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").createOrReplaceTempView("named")
    asked = []

    def judge(df):
        asked.append(("judge", df.count()))
        return df.select("key", F.when(F.col("prompt").contains("'b'"), '{"valid": false, "confidence": 0.95, "reason": "wrong name"}').otherwise('{"valid": true, "confidence": 1}').alias("reply"))

    def fix(df):
        asked.append(("fix", df.count()))
        return df.select("key", F.when(F.col("prompt").contains("wrong name"), "```sql\nSELECT id FROM named WHERE name = 'a'\n```").when(F.col("prompt").contains("gone"), "SELECT COUNT(*) FROM named").otherwise("no idea").alias("reply"))

    rows = [
        (1, "Which is a?", "SELECT id FROM named WHERE name = 'a'"), (2, "Which is a?", "SELECT id FROM named WHERE name = 'b'"), (3, "How many are there?", "SELECT gone FROM named"),
        (4, "How many are there?", "SELECT COUNT(*) FROM (SELECT id FROM named"), (5, "What?", "SELECT hopeless FROM named"), (6, "How many are called z?", "SELECT id FROM named WHERE name = 'z'"),
    ]
    samples = spark.createDataFrame([(i, q, "db", None, s) for i, q, s in rows], "qid int, question string, db_id string, schema_text string, SQL string")
    for turn in range(2):
        got = {r["qid"]: r for r in repair.repair(samples, str(tmp_path / "kept"), judge, fix, rounds=2).collect()}
        assert {i: (r["status"], r["rounds"]) for i, r in got.items()} == {1: ("ok", 0), 2: ("ok", 1), 3: ("ok", 1), 4: ("ok", 1), 5: ("error", 0), 6: ("ok", 0)}
        assert got[2]["SQL"].endswith("name = 'a'") and got[3]["SQL"] == "SELECT COUNT(*) FROM named;" and "fails" in got[5]["issue"] and got[6]["issue"] == "empty result for a count"
        assert all(got[i]["issue"] is None for i in (1, 2, 3, 4))
        if not turn:
            first = [x for x in asked if x[1]]
            asked.clear()
    assert first and not [x for x in asked if x[1]]
    assert repair.repair(samples.limit(0), str(tmp_path / "none"), judge, fix).count() == 0
    # Without anyone to ask, rules alone are tried.
    alone = {r["qid"]: r["status"] for r in repair.repair(samples, str(tmp_path / "alone"), rounds=1).collect()}
    assert alone[4] == "ok" and alone[3] == "error"


def test_cleaning_with_a_judge(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").createOrReplaceTempView("named")
    rows = [(1, "Which is a?", "SELECT id, MAX(name) FROM named", "db"), (2, "Which?", "SELECT id FROM named WHERE name = 'b'", "db"), (3, "None?", "SELECT id FROM named WHERE id > 5", "db"), (4, "Broken?", "SELECT x", "db")]
    samples = spark.createDataFrame(rows, "idx int, question string, SQL string, db_id string")
    calls = []

    def judge(df):
        calls.append(df.count())
        return df.select("key", F.when(F.col("prompt").contains("Which is a?"), '{"valid": true, "confidence": 0.9}').otherwise('{"valid": true, "confidence": 0.2}').alias("reply"))

    schemas = {"db": {"named": {"id": "int", "name": "string"}}}
    for folder in ("c", "c"):
        got = dataset.clean(samples, str(tmp_path / folder), judge, schemas=schemas)
        assert [(r["idx"], r["SQL"]) for r in got.collect()] == [(1, "SELECT id, MAX(name) FROM named")]
    assert calls[0] == 2 and not any(calls[1:])


def test_streamed_means_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{i % 3}", i, None if i % 11 == 0 else round(rng.random(), 3)) for i in range(300)]
    source, out, state = (str(tmp_path / n) for n in ("s", "o", "c"))
    for part in (rows[:100], rows[100:110], rows[110:]):
        rng.shuffle(part)
        spark.createDataFrame(part, "k string, step long, v double").repartition(3).write.mode("append").parquet(source)
        rollups.drained(monitors.means(rollups.read(spark, source, "k string, step long, v double"), "k", "step", "v", 5), out, state)
    got = {(r["k"], r["step"]): (r["running_mean"], r["trailing_mean"]) for r in spark.read.parquet(out).collect()}
    df = spark.createDataFrame(rows, "k string, step long, v double")
    running = {(r["k"], r["step"]): r["running_mean"] for r in reward.running_mean(df, "step", "v", "k").collect()}
    trailing = {(r["k"], r["step"]): r["trailing_mean"] for r in reward.trailing_mean(df, "step", "v", 5, "k").collect()}
    assert len(got) == 300
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - float(b)) < 1e-6)
    for key, (a, b) in got.items():
        assert near(a, running[key]) and near(b, trailing[key]), key


def test_diversity_of_arrays(spark):
    df = spark.createDataFrame([(1, ["a", " A", "b"]), (2, []), (3, None)], "i int, r array<string>")
    assert [r[0] for r in df.orderBy("i").select(monitors.group_diversity(F.col("r"))).collect()] == [2 / 3, None, None]


def test_templates_of_chats(spark):
    df = spark.createDataFrame([(1, [("user", "x"), ("assistant", None)])], f"i int, m {MESSAGES}")
    assert df.select(training.templated(F.col("m"))).first()[0] == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
