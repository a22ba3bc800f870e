"""Operators on small fixtures with results worked out by hand, and metamorphic checks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from querysmith.functions import mutations, schema_text, sql_parse, sql_text, text
from querysmith.operators import compare, dedup, evaluate, lsh, profile, reward, stats, vectors, vote
from querysmith.queries import QUERIES
from querysmith.sources import catalog


@pytest.fixture(scope="module")
def company(spark):
    departments = spark.createDataFrame([(1, "Engineering", 500000.0), (2, "Marketing", 200000.0), (3, "Sales", 300000.0)], "dept_id long, dept_name string, budget double")
    people = [(1, "Alice", 1, 120000.0), (2, "Bob", 1, 110000.0), (3, "Cara", 2, 90000.0), (4, "Dan", 3, 80000.0), (5, "Eve", 1, 130000.0), (6, "Fay", 2, 95000.0), (7, "Gus", 3, 70000.0), (8, "Hal", None, 100000.0)]
    employees = spark.createDataFrame(people, "emp_id long, name string, dept_id long, salary double")
    return catalog.Database.of({"departments": departments, "employees": employees}, {"departments": ["dept_id"], "employees": ["emp_id"]}, [("employees", "dept_id", "departments", "dept_id")])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_catalog_and_profile(spark, company):
    assert company.names == ["departments", "employees"]
    keys = {(r["table"], r["column"]): r["key"] for r in catalog.column_keys(company.columns(), company.foreign_keys()).collect()}
    assert keys["employees", "dept_id"] == "FK->departments.dept_id" and keys["employees", "emp_id"] == "PK" and keys["employees", "name"] == ""
    got = {r["column"]: r for r in profile.profile("employees", company.table("employees")).collect()}
    assert (got["salary"]["distinct_count"], got["salary"]["min"], got["salary"]["max"]) == (8, "70000.0000", "130000.0000")
    assert got["dept_id"]["null_count"] == 1 and got["dept_id"]["row_count"] == 8
    assert rows(profile.top_values(company.table("employees"), "dept_id", 2)) == [("dept_id", 1, 3, 1), ("dept_id", 2, 2, 2)]
    assert rows(profile.samples(company.table("departments"), "dept_name", 2)) == [("dept_name", "Engineering"), ("dept_name", "Marketing")]
    assert rows(catalog.orphans(company)) == [("employees.dept_id", 7, 1)]


def test_schema_texts(company):
    columns = catalog.column_keys(company.columns(), company.foreign_keys())
    samples = profile.samples(company.table("departments"), "dept_name", 3).withColumn("table", F.lit("departments"))
    examples = schema_text.example_lists(samples, columns)
    light = {r[0]: r[1] for r in rows(schema_text.light(columns, examples))}
    assert "| dept_name | VARCHAR |  | e.g. 'Engineering', 'Marketing', 'Sales' |" in light["departments"]
    assert "| dept_id | BIGINT | FK->departments.dept_id |  |" in light["employees"]
    ddl = {r[0]: r[1] for r in rows(schema_text.ddl(columns, examples))}
    assert ddl["departments"].startswith('CREATE TABLE "departments" (\n  "dept_id" BIGINT PRIMARY KEY') and ddl["departments"].endswith("\n);")
    assert "-- employees.dept_id -> departments.dept_id" in schema_text.link_comments(company.foreign_keys()).first()[0]


def test_result_comparison(spark):
    f = lambda data, ddl: spark.createDataFrame(data, ddl)
    a = f([(1, "x"), (2, "y")], "a int, b string")
    assert compare.same_results(a, f([(2, "Y "), (1, "X")], "c int, d string"))
    assert not compare.same_results(a, f([(1, "x"), (2, "z")], "a int, b string"))
    assert compare.same_results(f([(3.14159,)], "a double"), f([(3.1416,)], "a double"))
    assert not compare.same_results(a, f([(1, "x")], "a int, b string"))
    assert not compare.same_results(f([(1,)], "a int"), f([(1, 2)], "a int, b int"))
    assert compare.same_results(f([], "a int"), f([], "a int, b int"))
    assert compare.same_results(None, None) and not compare.same_results(a, None)
    assert compare.same_results(f([(None,), (1,)], "a int"), f([(1,), (None,)], "a int"))
    assert compare.same_results(f([(1,)], "a int"), f([("1",)], "a string"))
    assert compare.result_key(a) == compare.result_key(a.orderBy(F.desc("a"))) != compare.result_key(a.limit(1))
    assert compare.result_key(None) == compare.ERROR_KEY and compare.result_key(a.limit(0)) == compare.EMPTY_KEY


def test_minhash_against_a_model(spark):
    def model(s):
        s = s.lower().strip()
        grams = {s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}
        hashed = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]
        return [min((a * h + b) % lsh.PRIME for h in hashed) for a, b in lsh.coefficients()]

    values = ["Engineering", " ab ", "", "données", "aaaa"]
    got = dict(rows(spark.createDataFrame([(v,) for v in values], "value string").select("value", lsh.signature(F.col("value")))))
    assert all(got[v] == model(v) for v in values)
    entries = spark.createDataFrame([("blue car",), ("blue cart",), ("green tree",)], "value string").withColumn("signature", lsh.signature(F.col("value")))
    top = rows(lsh.look_up(entries, entries.filter("value = 'blue car'").select(F.col("value").alias("qid"), "signature"), 2))
    assert [t[1] for t in top] == ["blue car", "blue cart"] and top[0][2] == 1.0


def test_value_hints_look_at_values_of_any_length(spark, tmp_path):
    long = "LARGE " * 100 + "PLATED"
    spark.createDataFrame([(i * 100, v) for i, v in enumerate(("LARGE", "SMALL", long))] + [(7, "TINY")], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    hints = dict(rows(QUERIES["value_hints"](spark, str(tmp_path))))
    assert set(hints) == {"LARGE", "SMALL", long} and all(f"'{long}'" in h for h in hints.values())


def test_cosine_search(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "b")], "id int, v array<double>, g string")
    asked = e.filter("id = 1").select(F.col("id").alias("qid"), F.col("v").alias("q"), "g")
    assert [r[1] for r in rows(vectors.top_k(e.drop("g"), asked.drop("g"), 5))] == [2, 3]
    alone = spark.createDataFrame([(9, [1.0, 1.0], "z")], "qid int, q array<double>, g string")
    assert {r[0] for r in rows(vectors.top_k_or_any(e, asked.unionByName(alone), 1, "g"))} == {1, 9}


def test_extraction_and_skeletons(spark):
    cases = {
        "```sql\nSELECT 1\n```": "SELECT 1", "SELECT name FROM students;": "SELECT name FROM students;", "SQL: SELECT a FROM t": "SELECT a FROM t",
        "x SELECT a; SELECT a, b FROM t; y": "SELECT a, b FROM t;", "": "", "no query": "no query", "DROP TABLE t; bye": "DROP TABLE t;",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert dict(rows(df.select("t", sql_parse.extract_sql(F.col("t"))))) == cases
    one = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one("Sold 'red' cars after 2020/1/05 or 3-4-2021, over 12.5 in b2?", text.question_skeleton) == "Sold <STRING> cars after <DATE> or <DATE>, over <NUMBER> in b2?"
    assert one("SELECT a1 FROM t WHERE x = 'y' AND z > 3.5 LIMIT 10", sql_text.skeleton) == "SELECT a1 FROM t WHERE x = PLACEHOLDER AND z > NUM LIMIT 10"
    assert one("a  b\n c", text.word_count) == 3 and one("", text.word_count) == 0


def test_sql_parts_and_mutations(spark):
    sql = "SELECT a.x, COUNT(*) FROM t1 a LEFT OUTER JOIN t2 AS b ON a.id = b.id WHERE a.y > 3 AND b.z = 'q > 1' GROUP BY a.x ORDER BY a.x"
    df = spark.createDataFrame([(sql,)], "s string")
    c = df.select(sql_parse.components(F.col("s")).alias("c")).first()["c"]
    assert c["tables"] == ["t1", "t2"] and c["joins"][0]["type"] == "LEFT JOIN" and c["joins"][0]["on"] == "a.id = b.id"
    assert c["conditions"] == ["a.y > 3 AND b.z = 'q > 1'"] and c["group_by"] == ["a.x"] and c["ordering"] == ["a.x"] and c["aggregations"] == ["COUNT(*)"]
    assert df.select(sql_text.column_refs(F.col("s"))).first()[0] == ["t1.id", "t1.x", "t1.y", "t2.id", "t2.z"]
    m = {n: df.select(f(F.col("s"))).first()[0] for n, f in sql_text.MUTATIONS.items()}
    assert "t1 a INNER JOIN t2" in m["wrong_join_type"] and "a.y <= 3" in m["wrong_operator"] and "'q > 1'" in m["wrong_operator"]
    assert m["missing_condition"].count("AND") == 0 and "GROUP BY" in m["missing_condition"]
    assert m["missing_distinct"].startswith("SELECT DISTINCT a.x") and m["wrong_order"].endswith("ORDER BY a.x DESC")
    assert "COUNT(" not in m["wrong_aggregation"] and m["table_alias"].startswith("SELECT b.x") and "b.id = a.id" in m["table_alias"]
    joins = {"a CROSS JOIN b": "a INNER JOIN b", "a FULL OUTER JOIN b": "a LEFT JOIN b", "a RIGHT JOIN b": "a LEFT JOIN b", "a JOIN b": "a LEFT JOIN b", "a INNER JOIN b LEFT JOIN c": "a INNER JOIN b INNER JOIN c"}
    got = dict(rows(spark.createDataFrame([(j,) for j in joins], "s string").select("s", sql_text.wrong_join(F.col("s")))))
    assert got == joins
    plain = spark.createDataFrame([("SELECT x",)], "s string")
    assert all(plain.select(f(F.col("s"))).first()[0] is None for n, f in sql_text.MUTATIONS.items() if n != "missing_distinct")


def test_first_copies_and_splits(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(60)], "idx int, t string")
    kept = dedup.keep_first(df, F.col("t"), "idx")
    assert sorted(r[0] for r in rows(kept)) == list(range(7))
    assert sorted(rows(dedup.keep_first(kept, F.col("t"), "idx"))) == sorted(rows(kept))
    for ratio, want in ((0.05, 3), (0.0, 1), (1.0, 60)):
        parts = [r["split"] for r in dedup.split(df, "idx", 42, ratio).collect()]
        assert parts.count("val") == want and len(parts) == 60
    assert [r["split"] for r in dedup.split(df, "idx", 1, size=60).collect()] == ["train"] * 60
    shuffledrows = df.repartition(5).orderBy("t")
    assert sorted(rows(dedup.split(df, "idx", 9, 0.3).select("idx", "split"))) == sorted(rows(dedup.split(shuffledrows, "idx", 9, 0.3).select("idx", "split")))


def test_splits_by_long_keys(spark):
    # The border lies within a hash prefix, so that the last row's key is compared; a null key comes last.
    df = spark.range(5000).select(F.col("id").alias("k"))
    order = sorted(range(5000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    first = next(i for i in range(1, 5000) if hashlib.md5(f"7:{order[i - 1]}".encode()).hexdigest()[:4] == hashlib.md5(f"7:{order[i]}".encode()).hexdigest()[:4])
    for cast in ("long", "int", "string"):
        got = dedup.split(df.select(F.col("k").cast(cast).alias("k")), "k", 7, size=first)
        assert {int(r["k"]) for r in got.collect() if r["split"] == "val"} == set(order[:first])
    parts = {r["k"]: r["split"] for r in dedup.split(df.unionByName(spark.createDataFrame([(None,)], "k long")), "k", 7, size=5000).collect()}
    assert parts.pop(None) == "train" and set(parts.values()) == {"val"}


def test_mutations_are_spread_and_read_equal_texts_once(spark, tiny, tmp_path):
    marks = str(tmp_path)

    def slow(x):
        open(f"{marks}/{random.random()}", "w").close()
        return f"{x}!" if x != "b" else None

    df = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(3000)], "i int, t string").coalesce(1)
    assert sorted(rows(df.select("t", mutations.of(F.col("t"), slow).alias("m")).distinct()), key=str) == sorted([("a", "a!"), ("b", None), (None, None)], key=str)
    assert len(list(tmp_path.iterdir())) <= 2 * 2
    for name in ("missing_condition", "wrong_order", "table_alias"):
        made = QUERIES[f"mutate_{name}"](spark, tiny)
        assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_statistics(spark):
    turns = spark.createDataFrame([(1, "user", "a b"), (1, "assistant", "c"), (2, "user", ""), (2, "assistant", None), (3, "user", "x y z")], "c int, role string, text string")
    got = {r["segment"]: (r["n"], r["min"], r["max"], r["mean"], r["median"]) for r in stats.word_lengths(turns, "c", "role", "text").collect()}
    assert got["user"] == (3, 0, 3, 1.7, 2) and got["total"] == (3, 0, 3, 2.0, 3) and got["assistant"] == (2, 0, 1, 0.5, 1)


def test_accuracy_and_errors(spark):
    facts = spark.createDataFrame(
        [(0, True, "ok", 1, "SELECT a FROM t", "SELECT a FROM t", "simple", "d1"), (1, False, "error", 0, "SELEC", "SELECT a FROM t", "simple", "d1"), (2, False, "timeout", 0, "SELECT 1", "SELECT 2", "odd", "d2"),
         (3, False, "ok", 0, "SELECT a FROM t", "SELECT a FROM t", "odd", "d2"), (4, False, "ok", 2, "SELECT b FROM t", "SELECT a FROM t", "moderate", "d2"), (5, False, "ok", 2, "SELECT a FROM t", "SELECT a FROM t WHERE b = 1", "moderate", "d2"),
         (6, False, "ok", 2, "SELECT a FROM t JOIN u ON 1 = 1", "SELECT a FROM t", "moderate", "d2"), (7, False, "ok", 2, "SELECT a FROM t", "SELECT a FROM t", "moderate", "d2")],
        "idx int, correct boolean, status string, n_rows int, pred_sql string, gold_sql string, difficulty string, db_id string",
    )
    got = {(r["level"], r["key"]): (r["correct"], r["total"], r["accuracy"]) for r in evaluate.accuracy(facts).collect()}
    assert got["overall", ""] == (1, 8, 0.125) and got["difficulty", "challenging"] == (0, 0, 0.0) and got["difficulty", "simple"] == (1, 2, 0.5) and got["database", "d2"] == (0, 6, 0.0)
    kinds = {r["kind"]: (r["n"], r["examples"]) for r in evaluate.error_taxonomy(facts).collect()}
    assert kinds == {"syntax_error": (1, "1"), "timeout": (1, "2"), "empty_result": (1, "3"), "wrong_columns": (1, "4"), "wrong_filter": (1, "5"), "wrong_join": (1, "6"), "wrong_aggregation": (0, ""), "other": (1, "7")}
    assert evaluate.scalar_accuracy(facts.limit(0)).first()[0] == 0.0


def test_votes(spark):
    c = [(1, 0, "x"), (1, 1, "y"), (1, 2, "y"), (2, 0, compare.ERROR_KEY), (2, 1, compare.ERROR_KEY), (3, 0, compare.ERROR_KEY), (3, 1, "b"), (3, 2, "a")]
    want = [(1, 1, 2), (2, 0, 0), (3, 1, 1)]
    for data in (c, random.Random(1).sample(c, len(c))):
        assert sorted(rows(vote.majority(spark.createDataFrame(data, "qid int, i int, key string")))) == want
    t = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0), (1, 2, 9.0), (2, 0, 1.0)], "qid int, i int, score double")
    assert sorted(rows(vote.tournament(t).select("qid", "i", "wins"))) == [(1, 1, 2), (2, 0, 0)]


def test_rewards(spark):
    r = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.1), ("b", 0.1), ("c", 1.0)], "g string, v double")
    got = sorted(rows(reward.advantages(r, "g", "v").select("g", F.round("advantage", 3))))
    assert got == [("a", -0.707), ("a", 0.707), ("b", 0.0), ("b", 0.0), ("c", 0.0)]
    assert {x[0] for x in rows(reward.informative(r, "g", "v"))} == {"a"}
    d = spark.createDataFrame([(1, "x"), (1, " X"), (1, "y"), (1, None)], "g int, t string")
    assert rows(reward.diversity(d, "g", "t")) == [(1, 4, 0.75, False)]
    assert reward.mean_diversity(reward.diversity(d.limit(0), "g", "t")).first()[0] == 1.0


def test_sql_reader():
    found = sql_parse.read("SELECT DISTINCT a.x, max(b.y) m FROM s.t a, u AS b -- JOIN v\nWHERE a.k = b.k AND note = 'FROM w' UNION SELECT z, 1 FROM (SELECT z FROM q WHERE z > 2) i ORDER BY m;")
    assert found["tables"] == ["t", "u", "q"] and found["joins"] == [] and found["has_subquery"] and found["has_distinct"]
    assert found["conditions"] == ["a.k = b.k AND note = 'FROM w'", "z > 2"] and found["aggregations"] == ["max(b.y)"]
    assert found["columns"] == ["t.x", "t.k", "t.note", "u.y", "u.k", "q.z"]
    assert sql_parse.read(None)["tables"] == [] and sql_parse.read("SELECT (1")["tables"] == []


def test_samples_are_shown_as_literals(spark):
    values = ["plain", "it's", 'say "x"', 'it\'s "x"', "a\\b\n"]
    shown = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(schema_text.quoted_sample(F.col("v"), F.lit("VARCHAR"))).collect()]
    assert shown == [repr(v) for v in values]


def test_running_and_trailing_means_against_a_model(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.choice([None, rng.randrange(100) / 4])) for i in range(300)]
    df = spark.createDataFrame(data, "i long, g string, v double")
    trail = {r["i"]: r["trailing_mean"] for r in reward.trailing_mean(df, "i", "v", 7, "g", block=20).collect()}
    whole = {r["i"]: r["running_mean"] for r in reward.running_mean(df, "i", "v", "g").collect()}
    mean = lambda x: round(sum(x) / len(x), 6) if x else None
    for i, g, _ in data:
        mine = [v for j, h, v in data if h == g and j <= i]
        assert (None if trail[i] is None else round(float(trail[i]), 6)) == mean([v for v in mine[-7:] if v is not None])
        assert (None if whole[i] is None else round(float(whole[i]), 6)) == mean([v for v in mine if v is not None])


def test_close_results_are_compared_place_by_place(spark):
    f = lambda data, ddl: spark.createDataFrame(data, ddl)
    a = [("x", i / 4, None) for i in range(50)]
    whole = f([("X ", i, None) for i in range(50)][::-1], "k string, v int, w int")
    assert compare.same_results(f(a, "k string, v double, w double"), whole.selectExpr("k", "v / 4", "w"))
    assert compare.same_results(f([("x", float(i), None) for i in range(50)], "k string, v double, w double"), whole)
    assert not compare.same_results(f([("x", float(i), None) for i in range(49)] + [("x", 49.5, None)], "k string, v double, w double"), whole)
    assert not compare.same_results(f([("x", float(i), None) for i in range(49)] + [("y", 49.0, None)], "k string, v double, w double"), whole)


def test_stage_details(spark):
    s = spark.createDataFrame([("a", True, 0.5), ("b", False, 1.0), ("a", None, None)], "db_id string, exec_valid boolean, semantic_confidence double")
    r = stats.stage_details(s).first()
    assert (r["top"], r["exec_valid"], r["semantic_valid"], r["confidence"]) == ("a(2), b(1)", 1, None, 0.75)
