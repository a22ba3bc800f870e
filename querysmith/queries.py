"""Registered queries of the engine's operators with their SQL equivalents, over the sales and text tables."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dialect, schema_text, sql_parse, sql_text, text, tokens
from .operators import collections, compare, dedup, evaluate, lsh, profile, ranks, reward, stats, vectors, vote
from .plans import execute, generated, models, repair, training, workload
from .sources import catalog, files, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SALES = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
WORDS_SQL = r"len(list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda w: w <> ''))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its equivalent."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> catalog.Database:
    return catalog.Database.at(spark, sf_dir, SALES)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: read(spark, sf_dir, n) for n in names}


# Catalog and profiles


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in SALES))
def _(spark, sf_dir):
    return profile.row_counts(tables(spark, sf_dir, *SALES))


_FKS = workload.values(catalog.FOREIGN_KEYS, "ft, fc, tt, tc", "fk")
_PKS = workload.values([(t, c) for t, cs in catalog.PRIMARY_KEYS.items() for c in cs], "t, c", "pk")
_COLUMNS = f"""SELECT table_name AS "table", ordinal_position - 1 AS cid, column_name AS "column", data_type AS "type",
  coalesce('FK->' || fk.tt || '.' || fk.tc, CASE WHEN pk.c IS NOT NULL THEN 'PK' END, '') AS "key"
FROM information_schema.columns LEFT JOIN {_FKS} ON table_name = fk.ft AND column_name = fk.fc
LEFT JOIN {_PKS} ON table_name = pk.t AND column_name = pk.c WHERE table_name IN ({', '.join(f"'{t}'" for t in SALES)})"""


@query("catalog_columns", f'SELECT "table", CAST(cid AS INTEGER) AS cid, "column", "type", "key" FROM ({_COLUMNS})')
def _(spark, sf_dir):
    db = sales(spark, sf_dir)
    return catalog.column_keys(db.columns(), db.foreign_keys()).select("table", "cid", "column", "type", "key")


def _orphan_sql() -> str:
    one = "SELECT '{0}.{1}' AS link, count(b.{3}) AS matched, count(*) - count(b.{3}) AS orphans FROM {0} a LEFT JOIN {2} b ON a.{1} = b.{3}"
    return " UNION ALL ".join(one.format(*k) for k in catalog.FOREIGN_KEYS)


@query("fk_orphans", _orphan_sql())
def _(spark, sf_dir):
    return catalog.orphans(sales(spark, sf_dir))


@query("fk_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda how, kind: c.join(o, on, how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


_PROFILED = {
    "region": [("r_regionkey", "n"), ("r_name", "n")],
    "nation": [("n_nationkey", "n"), ("n_name", "n"), ("n_regionkey", "n")],
    "customer": [("c_custkey", "n"), ("c_name", "n"), ("c_nationkey", "n"), ("c_acctbal", "d"), ("c_mktsegment", "n")],
    "supplier": [("s_suppkey", "n"), ("s_name", "n"), ("s_nationkey", "n"), ("s_acctbal", "d")],
    "part": [("p_partkey", "n"), ("p_name", "n"), ("p_brand", "n"), ("p_type", "n"), ("p_size", "n"), ("p_retailprice", "d")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "n"), ("o_totalprice", "d"), ("o_orderdate", "t"), ("o_orderpriority", "n")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "d"), ("l_extendedprice", "d"), ("l_discount", "d"), ("l_tax", "d"), ("l_returnflag", "n"), ("l_linestatus", "n"), ("l_shipdate", "t")],
}
_TEXT_FORM = {"n": "CAST({} AS VARCHAR)", "d": "printf('%.4f', {})", "t": "strftime({}, '%Y-%m-%d %H:%M:%S')"}


def _profile_sql() -> str:
    one = "SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, {lo} AS \"min\", {hi} AS \"max\" FROM {t}"
    return " UNION ALL ".join(one.format(t=t, c=c, lo=_TEXT_FORM[k].format(f"min({c})"), hi=_TEXT_FORM[k].format(f"max({c})")) for t, cs in _PROFILED.items() for c, k in cs)


@query("profile_columns", _profile_sql())
def _(spark, sf_dir):
    return profile.profiles(tables(spark, sf_dir, *_PROFILED))


def _top_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 5"


@query("top_values", f"{_top_sql('orders', 'o_orderpriority')} UNION ALL {_top_sql('events', 'event_type')} UNION ALL {_top_sql('part', 'p_brand')}")
def _(spark, sf_dir):
    pick = [("orders", "o_orderpriority"), ("events", "event_type"), ("part", "p_brand")]
    a, b, c = (profile.top_values(read(spark, sf_dir, t), c) for t, c in pick)
    return a.unionByName(b).unionByName(c)


@query("column_samples", "(SELECT DISTINCT 'p_brand' AS \"column\", p_brand AS value FROM part WHERE p_brand IS NOT NULL ORDER BY value LIMIT 10) UNION ALL (SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer ORDER BY 2 LIMIT 10)")
def _(spark, sf_dir):
    return profile.samples(read(spark, sf_dir, "part"), "p_brand").unionByName(profile.samples(read(spark, sf_dir, "customer"), "c_mktsegment"))


#: Text columns whose examples schema texts show, besides a numeric one.
_EXAMPLES = [("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus")]


def _examples(spark, sf_dir, columns):
    pick = {"customer": ["c_nationkey"]}
    for t, c in _EXAMPLES:
        pick.setdefault(t, []).append(c)
    parts = [profile.samples(read(spark, sf_dir, t), c, 3).withColumn("table", F.lit(t)) for t, cs in pick.items() for c in cs]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return schema_text.example_lists(found, columns)


def _example_sql() -> str:
    one = "SELECT '{t}' AS \"table\", '{c}' AS \"column\", string_agg({q}, ', ' ORDER BY v) AS examples FROM (SELECT DISTINCT {c} AS v FROM {t} ORDER BY {o} LIMIT 3)"
    text_ = _EXAMPLES
    return " UNION ALL ".join([one.format(t=t, c=c, q="'''' || v || ''''", o="v") for t, c in text_] + [one.format(t="customer", c="c_nationkey", q="CAST(v AS VARCHAR)", o="v")])


@query(
    "schema_light",
    f"""WITH c AS ({_COLUMNS}), e AS ({_example_sql()})
SELECT c."table", '### Table: ' || c."table" || chr(10) || '| Column | Type | Key | Description |' || chr(10) || '|--------|------|-----|-------------|' || chr(10) ||
string_agg('| ' || c."column" || ' | ' || "type" || ' | ' || "key" || ' | ' || coalesce('e.g. ' || e.examples, '') || ' |', chr(10) ORDER BY cid) AS schema_text
FROM c LEFT JOIN e ON c."table" = e."table" AND c."column" = e."column" GROUP BY c."table\"""",
)
def _(spark, sf_dir):
    db = sales(spark, sf_dir)
    columns = catalog.column_keys(db.columns(), db.foreign_keys())
    return schema_text.light(columns, _examples(spark, sf_dir, columns))


@query(
    "schema_ddl",
    f"""WITH c AS ({_COLUMNS}), e AS ({_example_sql()})
SELECT c."table", 'CREATE TABLE "' || c."table" || '" (' || chr(10) || string_agg('  "' || c."column" || '" ' || "type" || CASE WHEN pk.c IS NOT NULL THEN ' PRIMARY KEY' ELSE '' END || coalesce('  -- e.g. ' || e.examples, ''), ',' || chr(10) ORDER BY cid) || chr(10) || ');' AS schema_text
FROM c LEFT JOIN e ON c."table" = e."table" AND c."column" = e."column" LEFT JOIN {_PKS} ON pk.t = c."table" AND pk.c = c."column" GROUP BY c."table\"""",
)
def _(spark, sf_dir):
    db = sales(spark, sf_dir)
    columns = db.columns()
    return schema_text.ddl(columns, _examples(spark, sf_dir, columns))


# Samples: filters, funnels, statistics


@query("required_filter", "SELECT count(*) AS n, count(*) FILTER (WHERE length(text) BETWEEN 1 AND 500) AS short FROM documents WHERE text IS NOT NULL AND text <> '' AND lang IS NOT NULL AND lang <> '' AND source IS NOT NULL AND source <> ''")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    good = d.filter(text.present(F.col("text")) & text.present(F.col("lang")) & text.present(F.col("source")))
    return good.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text").between(1, 500)).alias("short"))


@query(
    "retention_funnel",
    "WITH s AS (SELECT 0 AS step, 'loaded' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'labelled', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 2, 'good', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) "
    "SELECT step, stage, n, round(100.0 * n / greatest((SELECT n FROM s WHERE step = 0), 1), 4) AS \"percent\" FROM s",
)
def _(spark, sf_dir):
    d, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    return stats.retention({"loaded": d, "labelled": d.join(labels, "doc_id", "left_semi"), "good": d.join(labels.filter("quality = 1"), "doc_id", "left_semi")})


@query("stage_stats", "SELECT count(*) AS n, count(DISTINCT source) AS databases, round(avg(length(text)), 4) AS avg_question, min(length(text)) AS min_question, max(length(text)) AS max_question, round(avg(length(source)), 4) AS avg_sql FROM documents")
def _(spark, sf_dir):
    return stats.stage_statistics(read(spark, sf_dir, "documents"), "text", "source", "source")


@query(
    "word_length_stats",
    f"WITH w AS (SELECT conv_id, role, {WORDS_SQL.format('text')} AS w FROM conversations), s AS (SELECT conv_id, role AS segment, sum(w) AS n FROM w GROUP BY 1, 2 UNION ALL SELECT conv_id, 'total', sum(w) FROM w GROUP BY 1) "
    "SELECT segment, count(*) AS n, CAST(min(n) AS BIGINT) AS \"min\", CAST(max(n) AS BIGINT) AS \"max\", round(sum(n) / count(*), 1) AS mean, CAST(list_sort(list(n))[count(*) // 2 + 1] AS BIGINT) AS median FROM s GROUP BY segment",
)
def _(spark, sf_dir):
    return stats.word_lengths(read(spark, sf_dir, "conversations"), "conv_id", "role", "text")


@query("dist_sources", "WITH c AS (SELECT coalesce(source, 'unknown') AS value, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY 1) SELECT value, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS \"percent\" FROM c ORDER BY n DESC, seen LIMIT 15")
def _(spark, sf_dir):
    return stats.distribution(read(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"), 15)


@query("dist_languages", "WITH c AS (SELECT coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1) SELECT value, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS \"percent\" FROM c")
def _(spark, sf_dir):
    return stats.distribution(read(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"))


@query("dedup_keep_first", "SELECT doc_id, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, sf_dir):
    return dedup.keep_first(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", F.length("text").cast("long").alias("chars"))


@query("train_val_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, CAST(floor((SELECT count(*) FROM documents) * 0.05) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM documents")
def _(spark, sf_dir):
    return dedup.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 0.05)


@query("fixed_size_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) <= 500 THEN 'val' ELSE 'train' END AS split FROM orders")
def _(spark, sf_dir):
    return dedup.split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, size=500)


@query("seeded_cap", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def _(spark, sf_dir):
    return dedup.capped(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 100)


@query("batch_numbers", "SELECT \"table\", \"column\", (row_number() OVER (ORDER BY \"table\", cid) - 1) // 15 AS batch FROM (" + _COLUMNS + ")")
def _(spark, sf_dir):
    return profile.batches(sales(spark, sf_dir).columns(), ["table", "cid"], 15).select("table", "column", "batch")


@query("cache_split", "SELECT 'hit' AS kind, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'miss', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf_dir):
    hits, misses = files.split_cached(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id").distinct(), ["doc_id"])
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(hits, "hit").unionByName(count(misses, "miss"))


# Similarity

_FAMILY = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in lsh.coefficients()) + "]"
_SHINGLES = "CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substring(t, i, 3))) END"
_HASHED = f"list_transform({_SHINGLES}, lambda s: ('0x' || md5(s)[1:8])::BIGINT)"


def _signed(src: str) -> str:
    return f"(SELECT value, list_transform({_FAMILY}, lambda c: list_min(list_transform(h, lambda x: (c.a * x + c.b) % {lsh.PRIME}))) AS signature FROM (SELECT value, {_HASHED} AS h FROM (SELECT value, lower(trim(value)) AS t FROM ({src}))))"



@query("shingle_hash", f"SELECT value, list_sum({_HASHED})::BIGINT AS total, len({_HASHED}) AS n FROM (SELECT DISTINCT p_name AS value, lower(trim(p_name)) AS t FROM part)")
def _(spark, sf_dir):
    values = read(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    hashed = F.transform(lsh.shingles(F.col("value")), lsh.shingle_hash)
    return values.select("value", F.aggregate(hashed, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size(hashed).cast("bigint").alias("n"))


@query("minhash_signature", f"SELECT value, array_to_string(signature, ',') AS signature FROM {_signed('SELECT DISTINCT p_name AS value FROM part')}")
def _(spark, sf_dir):
    values = read(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    return values.select("value", F.array_join(F.transform(lsh.signature(F.col("value")), lambda x: x.cast("string")), ",").alias("signature"))


_SIMILAR = "round(len(list_filter(list_zip(q.signature, e.signature), lambda p: p[1] = p[2])) / 100, 4)"


@query(
    "minhash_topk",
    f"WITH e AS {_signed('SELECT DISTINCT p_name AS value FROM part')}, q AS (SELECT * FROM e WHERE value IN (SELECT p_name FROM part WHERE p_partkey % 100 = 0)) "
    f"SELECT q.value AS qid, e.value AS value, {_SIMILAR} AS similarity, CAST(row_number() OVER (PARTITION BY q.value ORDER BY {_SIMILAR} DESC, e.value) AS INTEGER) AS rank FROM q, e QUALIFY rank <= 5",
)
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    entries = part.select(F.col("p_name").alias("value")).distinct().withColumn("signature", lsh.signature(F.col("value")))
    asked = entries.join(part.filter("p_partkey % 100 = 0").select(F.col("p_name").alias("value")), "value", "left_semi").select(F.col("value").alias("qid"), "signature")
    return lsh.look_up(entries, asked, 5)


_COSINE = "1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"
_VECTORS = "(SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "cosine_topk",
    f"WITH e AS {_VECTORS}, q AS (SELECT * FROM e WHERE id % 100 = 0), d AS (SELECT q.id AS qid, e.id, {_COSINE} AS distance FROM q, e WHERE e.id <> q.id) "
    "SELECT qid, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM d WHERE distance IS NOT NULL QUALIFY rank <= 3",
)
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asked, 3).withColumn("distance", F.round("distance", 6))


@query(
    "cosine_topk_filtered",
    f"WITH e AS {_VECTORS}, q AS (SELECT * FROM e WHERE id % 100 = 0), d AS (SELECT q.id AS qid, e.id, {_COSINE} AS distance FROM q JOIN e ON e.label = q.label AND e.id <> q.id) "
    "SELECT qid, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM d WHERE distance IS NOT NULL QUALIFY rank <= 3",
)
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")
    return vectors.top_k_or_any(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), asked, 3, "label").withColumn("distance", F.round("distance", 6))


@query(
    "value_hints",
    f"WITH e AS {_signed('SELECT DISTINCT trim(p_type) AS value FROM part')}, q AS (SELECT * FROM e WHERE value IN (SELECT trim(p_type) FROM part WHERE p_partkey % 100 = 0)), "
    f"h AS (SELECT q.value AS qid, e.value AS value, row_number() OVER (PARTITION BY q.value ORDER BY {_SIMILAR} DESC, e.value) AS rank FROM q, e QUALIFY rank <= 4) "
    "SELECT qid, '-- Potentially relevant values:' || chr(10) || string_agg('- part.p_type: ''' || value || '''', chr(10) ORDER BY rank) AS hints FROM h GROUP BY qid",
)
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    values = profile.text_values({"part": part.select("p_type")}, most=None, longest=None)
    entries = lsh.index(values).select("value", "signature").distinct()
    asked = entries.join(part.filter("p_partkey % 100 = 0").select(F.trim("p_type").alias("value")), "value", "left_semi").select(F.col("value").alias("qid"), "signature")
    hits = lsh.look_up(entries, asked, 4).join(values, "value")
    return vectors.value_hints(hits)


# Text and SQL functions

@query("question_skeleton", "SELECT o_orderkey, 'Was <STRING> due <DATE>, <DATE> or <DATE> at <NUMBER>, room' || o_orderkey || '? <STRING>' AS skeleton FROM orders")
def _(spark, sf_dir):
    day = lambda form: F.date_format("o_orderdate", form)
    asked = F.concat(F.lit("Was '"), "o_orderpriority", F.lit("' due "), day("yyyy/MM/dd"), F.lit(", "), day("dd-MM-yyyy"), F.lit(" or "), day("yyyy-M-d"), F.lit(" at "), F.col("o_orderkey").cast("string"), F.lit(".5, room"), F.col("o_orderkey").cast("string"), F.lit('? "x 12"'))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.question_skeleton(asked).alias("skeleton"))


def _generated(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    made = F.concat(F.lit("SELECT p_name FROM part WHERE p_brand = '"), "p_brand", F.lit("' AND p_size > "), F.col("p_size").cast("string"), F.lit(" AND p_retailprice < "), F.bround("p_retailprice").cast("bigint").cast("string"), F.lit(".5 LIMIT "), (F.col("p_size") % 7).cast("string"))
    return p.select("p_partkey", made.alias("sql"))


@query("sql_skeleton", "SELECT p_partkey, 'SELECT p_name FROM part WHERE p_brand = PLACEHOLDER AND p_size > NUM AND p_retailprice < NUM LIMIT ' || (p_size % 7) AS skeleton FROM part")
def _(spark, sf_dir):
    return _generated(spark, sf_dir).select("p_partkey", sql_text.skeleton(F.col("sql")).alias("skeleton")).filter(F.trim("skeleton") != "")


def _samples(spark, sf_dir):
    return generated.samples(read(spark, sf_dir, "part"))


@query("sql_extract", f"SELECT p_partkey, {generated.case('p_partkey % 7', [x[1].replace('{q}', generated.SHORT) for x in generated.REPLIES])} AS sql FROM part")
def _(spark, sf_dir):
    reply = F.expr(generated.case("p_partkey % 7", [x[0].replace("{q}", generated.SHORT) for x in generated.REPLIES]))
    return read(spark, sf_dir, "part").select("p_partkey", sql_parse.extract_sql(reply).alias("sql"))


_NAMED = workload.values([(q, i, workload.OTHER_TABLES.get((q, i), workload.TABLES[q]), workload.TABLES[q]) for q, i, _ in workload.CANDIDATES], "qid, i, tables, gold_tables", "t")


_GOLD_TABLES = [",".join(sorted(t)) for t in generated.TABLES]


@query("sql_tables", f"SELECT p_partkey, {generated.case(generated.FORM, _GOLD_TABLES, True)} AS gold_tables, array_to_string(list_sort(list_distinct(string_split({generated.case(generated.FORM, _GOLD_TABLES, True)}, ',') || CASE WHEN {generated.VARIANT} = 2 THEN ['events', 'region'] ELSE [] END)), ',') AS tables FROM part")
def _(spark, sf_dir):
    named = lambda c: F.array_join(sql_text.tables(F.col(c)), ",")
    return _samples(spark, sf_dir).select("p_partkey", named("gold").alias("gold_tables"), named("sql").alias("tables"))


@query(
    "sql_components",
    f"""SELECT p_partkey, {generated.case(generated.FORM, generated.AGGREGATIONS, True)} AS aggregations, CAST({generated.case(generated.FORM, map(len, generated.JOINS))} AS BIGINT) AS joins, {generated.case(generated.FORM, generated.CONDITIONS)} AS conditions,
{generated.case(generated.FORM, generated.ORDERING, True)} AS ordering, {generated.case(generated.FORM, generated.GROUPS, True)} AS group_by, {generated.FORM} = 2 AS has_subquery, {generated.FORM} = 1 AS has_distinct FROM part""",
)
def _(spark, sf_dir):
    flat = _samples(spark, sf_dir).select("p_partkey", sql_parse.components(F.col("gold")).alias("c"))
    joined = lambda x: F.element_at(F.concat(F.col(f"c.{x}"), F.array(F.lit(""))), 1).alias(x)
    return flat.select("p_partkey", joined("aggregations"), F.size("c.joins").cast("bigint").alias("joins"), joined("conditions"), joined("ordering"), joined("group_by"), "c.has_subquery", "c.has_distinct")


@query("sql_joins", " UNION ALL ".join(f"SELECT p_partkey, '{kind}' AS type, '{table}' AS \"table\", {on} AS \"on\" FROM part WHERE {generated.FORM} = {form}" for form, joins in enumerate(generated.JOINS) for kind, table, on in joins))
def _(spark, sf_dir):
    c = _samples(spark, sf_dir).select("p_partkey", F.explode(sql_parse.components(F.col("gold"))["joins"]).alias("j"))
    return c.select("p_partkey", "j.type", "j.table", "j.on")


#: Joins that the reader has to tell apart, as SQL expressions over a nation, and the types that each has.
_JOIN_FORMS = (
    ("'SELECT * FROM a LEFT OUTER JOIN b ON a.x = ' || n_nationkey", "LEFT JOIN"), ("'SELECT * FROM ' || n_name || ' NATURAL JOIN b'", "NATURAL JOIN"),
    ("'SELECT * FROM a FULL JOIN b USING (k_' || n_nationkey || ') CROSS JOIN c'", "FULL JOIN,CROSS JOIN"), ("'SELECT ''(' || n_name || ' JOIN)'' AS x FROM a, b -- JOIN ' || n_name", ""),
    ("'SELECT x FROM (SELECT * FROM a INNER JOIN b ON LEFT(a.x, ' || n_nationkey || ') = b.x) s RIGHT JOIN c ON s.x = c.x'", "RIGHT JOIN,INNER JOIN"),
)


@query("sql_join_forms", f"SELECT n_nationkey, {generated.case('n_nationkey % 5', [t for _, t in _JOIN_FORMS], True)} AS types FROM nation")
def _(spark, sf_dir):
    made = F.expr(generated.case("n_nationkey % 5", [e for e, _ in _JOIN_FORMS]))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(sql_parse.components(made)["joins"], lambda j: j["type"]), ",").alias("types"))


@query("column_refs", f"SELECT p_partkey, {generated.case(generated.FORM, generated.COLUMNS, True)} AS refs FROM part")
def _(spark, sf_dir):
    return _samples(spark, sf_dir).select("p_partkey", F.array_join(sql_text.column_refs(F.col("gold")), ",").alias("refs"))


@query("complex_flag", f"SELECT p_partkey, {generated.FORM} BETWEEN 1 AND 3 AS is_complex FROM part")
def _(spark, sf_dir):
    return _samples(spark, sf_dir).select("p_partkey", sql_text.is_complex(F.col("gold")).alias("is_complex"))


def _pairs(spark):
    return workload.candidates(spark).join(workload.questions(spark), "qid")


_PAIRS = f"(SELECT k.qid, k.i, k.sql, w.gold, w.difficulty, w.db_id, w.question FROM {workload.CANDIDATES_SQL} JOIN {workload.QUESTIONS_SQL} ON k.qid = w.qid)"


@query("table_set_equal", f"SELECT p_partkey, {generated.VARIANT} < 2 AS same FROM part")
def _(spark, sf_dir):
    return _samples(spark, sf_dir).select("p_partkey", sql_text.same_tables(F.col("sql"), F.col("gold")).alias("same"))


@query("sql_normalised", f"SELECT p_partkey, {generated.VARIANT} = 0 AS same FROM part")
def _(spark, sf_dir):
    return _samples(spark, sf_dir).select("p_partkey", (text.normalised_sql(F.col("sql")) == text.normalised_sql(F.col("gold"))).alias("same"))


@query("error_differences", f"SELECT p_partkey, {generated.VARIANT} > 0 AS columns_differ, CASE {generated.FORM} WHEN 0 THEN {generated.VARIANT} <> 1 WHEN 2 THEN true ELSE false END AS filters_differ, {generated.VARIANT} = 2 AS joins_differ, {generated.VARIANT} = 2 AS aggregates_differ FROM part")
def _(spark, sf_dir):
    s, g = F.col("sql"), F.col("gold")
    return _samples(spark, sf_dir).select("p_partkey", sql_text.differs_in_columns(s, g).alias("columns_differ"), sql_text.differs_in_filter(s, g).alias("filters_differ"), sql_text.differs_in_joins(s, g).alias("joins_differ"), sql_text.differs_in_aggregates(s, g).alias("aggregates_differ"))


#: Three forms of generated queries, with the parts that mutations change in brackets, as SQL text expressions over part.
_FORMS = [
    "'SELECT DISTINCT p.p_name, s.s_name FROM part p LEFT OUTER JOIN supplier s ON p.p_partkey = s.s_suppkey WHERE p.p_size >= ' || p_size || ' AND p.p_brand = ''' || p_brand || ''' ORDER BY p.p_name ASC'",
    "'SELECT p_brand, COUNT(p_size) AS m FROM part CROSS JOIN region WHERE p_size <> ' || p_size || ' GROUP BY p_brand ORDER BY m DESC LIMIT 5'",
    "'SELECT p_name, p_size FROM part JOIN nation ON p_size = n_nationkey WHERE p_retailprice < ' || p_size || ' ORDER BY p_size, p_name'",
]
#: What each mutation makes of each form (replacements in the form, by the rules of the mutations); None: it doesn't apply.
_MUTATED = {
    "column_swap": [[("p.p_name, s.s_name", "p.s_name, s.p_name")], [("p_brand, COUNT(p_size)", "p_size, COUNT(p_brand)")], [("p_name, p_size FROM", "p_size, p_name FROM")]],
    "table_alias": [[("p.", "~."), ("s.", "p."), ("~.", "s.")], None, None],
    "wrong_aggregation": [None, [("COUNT(", "' || ['SUM', 'AVG', 'MIN', 'MAX'][(('0x' || md5({form})[1:8])::BIGINT % 4) + 1] || '(")], None],
    "missing_condition": [[(" AND p.p_brand = ''' || p_brand || '''", "")], [(" WHERE p_size <> ' || p_size || '", "")], [(" WHERE p_retailprice < ' || p_size || '", "")]],
    "wrong_join_type": [[("LEFT OUTER JOIN", "INNER JOIN")], [("CROSS JOIN", "INNER JOIN")], [("part JOIN", "part LEFT JOIN")]],
    "wrong_operator": [[(">=", "<")], [("<>", "=")], [("<", ">=")]],
    "missing_distinct": [[("SELECT DISTINCT", "SELECT")], [("SELECT", "SELECT DISTINCT")], [("SELECT", "SELECT DISTINCT")]],
    "wrong_order": [[("p_name ASC", "p_name DESC")], [("m DESC", "m ASC")], [("BY p_size,", "BY p_size DESC,")]],
}


def _mutated_sql(changes: list) -> str:
    cases = []
    for n, (form, change) in enumerate(zip(_FORMS, changes, strict=True)):
        made = form if change else "CAST(NULL AS VARCHAR)"
        for old, new in change or []:
            made = made.replace(old, new.replace("{form}", form))
        cases.append(f"WHEN {n} THEN {made}")
    return f"SELECT p_partkey, CASE p_partkey % 3 {' '.join(cases)} END AS mutated FROM part"


def _mutation(name: str) -> None:
    @query(f"mutate_{name}", _mutated_sql(_MUTATED[name]))
    def _(spark, sf_dir):
        quoted = [form.replace("''' || p_brand || '''", "\\'' || p_brand || '\\'") for form in _FORMS]  # Spark escapes quotes by backslashes
        rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work a row
        forms = rows.selectExpr("p_partkey", f"CASE p_partkey % 3 {' '.join(f'WHEN {n} THEN {form}' for n, form in enumerate(quoted))} END AS sql")
        return forms.select("p_partkey", sql_text.MUTATIONS[name](F.col("sql")).alias("mutated"))


for _name in _MUTATED:
    _mutation(_name)


@query("task_detect", "SELECT task, count(*) AS n FROM (SELECT CASE WHEN t LIKE '%schema linking%' OR t LIKE '%identify the relevant%' THEN 'schema_linking' WHEN t LIKE '%correct%' OR t LIKE '%fix%' OR t LIKE '%error%' THEN 'sql_correction' WHEN t LIKE '%skeleton%' OR t LIKE '%template%' THEN 'skeleton_extraction' WHEN t LIKE '%step-by-step%' OR t LIKE '%chain of thought%' THEN 'chain_of_thought' ELSE 'text2sql' END AS task FROM (SELECT lower(coalesce(text, '')) AS t FROM conversations)) GROUP BY task")
def _(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy(text.task_of(F.col("text")).alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("last_turns", "SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant, count(*) >= 2 AS trainable FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return lists.select("conv_id", text.last_of(F.col("m"), "user").alias("last_user"), text.last_of(F.col("m"), "assistant").alias("last_assistant"), text.trainable(F.col("m")).alias("trainable"))


@query("prompts", f"SELECT qid, 'Database Schema:' || chr(10) || db_id || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || CASE WHEN trim(evidence) <> '' THEN 'Evidence: ' || evidence || chr(10) || chr(10) ELSE '' END || 'Generate the SQL query.' AS prompt FROM {generated.SAMPLES_SQL}")
def _(spark, sf_dir):
    return _samples(spark, sf_dir).select("qid", text.user_prompt(F.col("db_id"), F.col("question"), F.col("evidence")).alias("prompt"))


@query("chat_records", " UNION ALL ".join(f"SELECT qid, '{task}' AS task, '{message.replace(chr(39), chr(39) * 2)}' AS system, question AS \"user\", gold AS assistant FROM {generated.SAMPLES_SQL}" for task, message in text.SYSTEM_MESSAGES.items()))
def _(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    each = [rows.select("qid", F.lit(task).alias("task"), text.chat(task, F.col("question"), F.col("gold")).alias("m")) for task in text.SYSTEM_MESSAGES]
    m = functools.reduce(DataFrame.unionByName, each)
    return m.select("qid", "task", *(text.last_of(F.col("m"), r).alias(r) for r in ("system", "user", "assistant")))


def _icl_sql() -> str:
    """Prompts of three styles for each brand, with its three first samples as examples; every second has a reasoning."""
    why = f"'Reasoning: ' || CASE WHEN qid % 2 = 0 THEN 'sizes decide in ' || qid ELSE '{text.NO_REASONING}' END || chr(10)"
    shown = lambda style: f"string_agg('Example ' || r || ':' || chr(10) || 'Question: ' || question || chr(10) || {why if style == 'cot' else chr(39) * 2} || 'SQL: ' || gold, chr(10) || chr(10) ORDER BY r)"
    last = lambda style: (text.DIVIDE if style == "divide" else text.INSTRUCTION).replace("'", "''")
    rows = f"(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY qid) AS r FROM {generated.SAMPLES_SQL})"
    one = "SELECT p_brand, '{s}' AS style, '### Database Schema:' || chr(10) || p_brand || chr(10) || chr(10) || '### Examples:' || chr(10) || {shown} || chr(10) || chr(10) || '### Question:' || chr(10) || 'Which part?' || chr(10) || chr(10) || '### Evidence:' || chr(10) || 'of ' || p_brand || chr(10) || chr(10) || '{last}' AS prompt FROM {rows} WHERE r <= 3 GROUP BY p_brand"
    return " UNION ALL ".join(one.format(s=s, shown=shown(s), last=last(s), rows=rows) for s in ("direct", "cot", "divide"))


@query("icl_prompt", _icl_sql())
def _(spark, sf_dir):
    first = _samples(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("qid"))).filter("r <= 3")
    reasoning = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("sizes decide in "), F.col("qid").cast("string")))
    lists = first.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("qid", "question", F.col("gold").alias("sql"), reasoning.alias("reasoning")))).alias("e"))
    styles = [lists.select("p_brand", F.lit(s).alias("style"), text.example_question(F.col("p_brand"), F.lit("Which part?"), F.concat(F.lit("of "), "p_brand"), F.col("e"), s).alias("prompt")) for s in ("direct", "cot", "divide")]
    return functools.reduce(DataFrame.unionByName, styles)


_SURE = f"CAST({generated.SHARE} AS DOUBLE)"


@query(
    "judge_verdicts",
    f"SELECT p_partkey, p_partkey % 4 IN (0, 3) AS valid, CASE p_partkey % 4 WHEN 0 THEN {_SURE} WHEN 1 THEN least(1.0, p_size + 0.5) ELSE 0.0 END AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'part ' || p_partkey WHEN 1 THEN 'wrong table' WHEN 2 THEN 'parse error' ELSE '' END AS reason FROM part",
)
def _(spark, sf_dir):
    reply = F.expr(generated.case("p_partkey % 4", generated.VERDICTS))
    return read(spark, sf_dir, "part").select("p_partkey", text.verdict(reply).alias("v")).select("p_partkey", "v.*")


@query("durations", "SELECT p_partkey, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(s) AS BIGINT) % 60 || 's' ELSE CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor(s / 60) AS BIGINT) % 60 || 'm' END AS shown FROM (SELECT p_partkey, p_retailprice * p_size / 8 AS s FROM part)")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.duration(F.col("p_retailprice") * F.col("p_size") / 8).alias("shown"))


@query("collection_names", "SELECT s_suppkey, regexp_replace(regexp_replace(CASE WHEN length(n) > 24 THEN n[1:16] || md5(s_name)[1:8] ELSE n END, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') AS name FROM (SELECT s_suppkey, s_name, regexp_replace('cells_' || s_name, '[^A-Za-z0-9_-]', '_', 'g') AS n FROM supplier)")
def _(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.collection_name(F.col("s_name"), longest=24).alias("name"))


@query("masked_labels", "SELECT l_orderkey, l_linenumber, array_to_string(list_transform(range(0, l_linenumber + 3), lambda i: CASE WHEN i >= 1 AND i < l_linenumber THEN i * 10 ELSE -100 END) || list_transform(range(0, greatest(0, 10 - l_linenumber - 3)), lambda i: -100), ',') AS labels FROM lineitem")
def _(spark, sf_dir):
    n = F.col("l_linenumber")
    ids = F.transform(F.sequence(F.lit(0), n + 2), lambda i: i * 10)
    spans = F.array(F.struct(F.lit(1).alias("start"), n.alias("end")))
    labels = text.padded(text.masked_labels(ids, spans), F.lit(10), -100)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


@query("seeded_choice", "SELECT p_partkey, ['LEFT', 'RIGHT', 'INNER'][(('0x' || md5(p_name)[1:8])::BIGINT % 3) + 1] AS choice FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.chosen(["LEFT", "RIGHT", "INNER"], F.col("p_name")).alias("choice"))


@query("repaired_sql", f"SELECT p_partkey, {generated.case('p_partkey % 4', [b[2] for b in generated.BROKEN])} AS fixed FROM part")
def _(spark, sf_dir):
    sql, error = (F.expr(generated.case("p_partkey % 4", [b[i] for b in generated.BROKEN])) for i in (0, 1))
    return read(spark, sf_dir, "part").select("p_partkey", sql_text.repaired(sql, error).alias("fixed"))


# Execution, comparison, evaluation


def _registered(spark, sf_dir):
    return catalog.Database.at(spark, sf_dir, [*SALES, "events"]).register()


_COUNTED = " UNION ALL ".join(f"SELECT {q} AS qid, 'error' AS status, 0 AS n_rows" if q in workload.BROKEN_GOLD else f"SELECT {q} AS qid, 'ok' AS status, (SELECT count(*) FROM ({gold})) AS n_rows" for q, *_, gold in workload.QUESTIONS)


@query("exec_validation", _COUNTED)
def _(spark, sf_dir):
    _registered(spark, sf_dir)
    return execute.validated(spark, workload.questions(spark), "gold", "qid", seconds=None).select("qid", "status", "n_rows")


#: Query texts in the dialect of the benchmark databases, made for each order priority ({p}; {q} in lower case), and
#: the rows that each has for a priority p, in SQL.
DIALECT_FORMS = {
    "least": "SELECT o_orderkey, MIN(o_totalprice) FROM orders WHERE o_orderpriority = '{p}' LIMIT 0, 5",
    "greatest": 'SELECT o_orderstatus, o_custkey, MAX(o_orderkey) AS "last one" FROM orders WHERE o_orderpriority = "{p}" GROUP BY o_orderstatus ORDER BY o_orderstatus',
    "dependent": "SELECT c.c_name, COUNT(o.o_orderkey) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority = '{p}' GROUP BY c.c_custkey ORDER BY n DESC, c.c_name LIMIT 2, 3",
    "truths": "SELECT SUM(iif(o_totalprice > 100000, 1, 0)), SUM(o_orderstatus = 'F'), TOTAL(o_custkey % 2 = 0) FROM orders WHERE o_orderpriority LIKE '{q}'",
    "listed": "SELECT o_orderstatus, length(group_concat(o_orderkey)), group_concat(DISTINCT o_orderstatus) FROM orders WHERE o_orderpriority = '{p}' GROUP BY o_orderstatus ORDER BY 1",
    "divided": "SELECT SUM(o_orderkey) / COUNT(*), COUNT(*) / 7 * 2, MAX(o_custkey) % 0, MAX(o_orderkey) / 2.0 FROM orders WHERE o_orderpriority = '{p}'",
    "months": "SELECT strftime('%Y-%m', o_orderdate) AS month, COUNT(*) AS n FROM orders WHERE o_orderpriority = '{p}' GROUP BY month ORDER BY n DESC, month LIMIT 1, 2",
    "shapes": "SELECT COUNT(*) FROM orders WHERE o_orderpriority GLOB '[1-3]-*' AND o_orderpriority IS '{p}' AND o_orderstatus IS NOT 'P'",
    "quoted": 'SELECT COUNT(*) AS "number of orders" FROM [orders] WHERE "o_orderpriority" = "{p}" AND max(o_custkey, 50) > 50',
    "broken": "SELECT COUNT(*) FROM orders WHERE o_orderpriority = '{p}' AND no_such_column / 2 > 1",
}


def _json_sql(*cells: str) -> str:
    """A row of texts as JSON shows it."""
    return "'[' || " + " || ', ' || ".join(f"coalesce('\"' || CAST({c} AS VARCHAR) || '\"', 'null')" for c in cells) + " || ']'"


def _dialect_sql() -> str:
    o = "(SELECT *, o_orderpriority AS p FROM orders)"
    rows = {
        "least": f"SELECT p, 1 AS r, {_json_sql('o_orderkey', 'o_totalprice')} AS row FROM {o} QUALIFY row_number() OVER (PARTITION BY p ORDER BY o_totalprice, o_orderkey) = 1",
        "greatest": f"SELECT p, row_number() OVER (PARTITION BY p ORDER BY o_orderstatus), {_json_sql('o_orderstatus', 'o_custkey', 'o_orderkey')} FROM (SELECT * FROM {o} QUALIFY row_number() OVER (PARTITION BY p, o_orderstatus ORDER BY o_orderkey DESC) = 1)",
        "dependent": f"SELECT p, r, {_json_sql('c_name', 'n')} FROM (SELECT p, c_name, n, row_number() OVER (PARTITION BY p ORDER BY n DESC, c_name) AS r FROM (SELECT p, o_custkey, any_value(c_name) AS c_name, count(*) AS n FROM {o} JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)) WHERE r BETWEEN 3 AND 5",
        "truths": f"SELECT p, 1, {_json_sql('count(*) FILTER (WHERE o_totalprice > 100000)', "count(*) FILTER (WHERE o_orderstatus = 'F')", 'CAST(count(*) FILTER (WHERE o_custkey % 2 = 0) AS DOUBLE)')} FROM {o} GROUP BY p",
        "listed": f"SELECT p, row_number() OVER (PARTITION BY p ORDER BY o_orderstatus), {_json_sql('o_orderstatus', 'n', 'o_orderstatus')} FROM (SELECT p, o_orderstatus, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) - 1 AS BIGINT) AS n FROM {o} GROUP BY 1, 2)",
        "divided": f"SELECT p, 1, {_json_sql('CAST(sum(o_orderkey) AS BIGINT) // count(*)', 'count(*) // 7 * 2', 'NULL', 'max(o_orderkey) / 2')} FROM {o} GROUP BY p",
        "months": f"SELECT p, r, {_json_sql('m', 'n')} FROM (SELECT p, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, strftime(o_orderdate, '%Y-%m')) AS r FROM {o} GROUP BY 1, 2) WHERE r IN (2, 3)",
        "shapes": f"SELECT p, 1, {_json_sql("count(*) FILTER (WHERE p[1] IN ('1', '2', '3') AND p[2] = '-' AND o_orderstatus <> 'P')")} FROM {o} GROUP BY p",
        "quoted": f"SELECT p, 1, {_json_sql('count(*) FILTER (WHERE o_custkey > 50)')} FROM {o} GROUP BY p",
    }
    found = " UNION ALL ".join(f"SELECT '{form}' AS form, * FROM ({sql}) AS t(p, r, row)" for form, sql in rows.items())
    return f"""SELECT form, p AS priority, 'ok' AS status, count(*) AS total, '[' || string_agg(row, ', ' ORDER BY r) || ']' AS preview FROM ({found}) GROUP BY form, p
UNION ALL SELECT DISTINCT 'broken', o_orderpriority, 'error', 0, '[]' FROM orders"""


def dialect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, priority and text of a query for each form and each priority that an order has."""
    forms = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.lit(v).alias("text")) for k, v in DIALECT_FORMS.items()))).alias("f")
    each = read(spark, sf_dir, "orders").filter("o_orderpriority IS NOT NULL").select(F.col("o_orderpriority").alias("priority")).distinct()
    made = F.replace(F.replace(F.col("f.text"), F.lit("{p}"), F.col("priority")), F.lit("{q}"), F.lower("priority"))
    return each.select("priority", forms).select(F.concat_ws("|", "f.form", "priority").alias("key"), "f.form", "priority", made.alias("sql"))


@query("gold_dialect", _dialect_sql())
def _(spark, sf_dir):
    _registered(spark, sf_dir)
    texts = dialect_texts(spark, sf_dir)
    ready = dialect.rewritten(texts, "sql", {"": dialect.schema_of(spark, ["orders", "customer"])})
    return texts.select("key", "form", "priority").join(execute.previews(spark, ready, "key", "sql", rows=5, seconds=None), "key").drop("key", "error")


def _judged_sql() -> str:
    """Multiset equality of each candidate's rows and the gold rows, by position; right only if both run."""
    gold = {q: g for q, *_, g in workload.QUESTIONS}
    parts = []
    for n, (q, i, s) in enumerate(workload.CANDIDATES):
        if (q, i) in workload.BROKEN:
            parts.append(f"SELECT {n} AS idx, 'error' AS pred_status, 0 AS n_rows, false AS correct")
        else:
            same = "false" if (q, i) in workload.NARROW or q in workload.BROKEN_GOLD else f"NOT EXISTS ((SELECT * FROM ({s}) EXCEPT ALL SELECT * FROM ({gold[q]})) UNION ALL (SELECT * FROM ({gold[q]}) EXCEPT ALL SELECT * FROM ({s})))"
            parts.append(f"SELECT {n} AS idx, 'ok' AS pred_status, (SELECT count(*) FROM ({s})) AS n_rows, {same} AS correct")
    return " UNION ALL ".join(parts)


def _judged(spark, sf_dir):
    _registered(spark, sf_dir)
    pairs = _numbered(spark).select("idx", F.col("sql").alias("pred_sql"), F.col("gold").alias("gold_sql"))
    return execute.judged(spark, pairs, seconds=None)


def _numbered(spark):
    rows = [(n, q, i) for n, (q, i, _) in enumerate(workload.CANDIDATES)]
    return spark.createDataFrame(rows, "idx int, qid int, i int").join(_pairs(spark), ["qid", "i"])


@query("result_compare", _judged_sql())
def _(spark, sf_dir):
    return _judged(spark, sf_dir).select("idx", "pred_status", "n_rows", "correct")


_IDX = workload.values([(n, q, i) for n, (q, i, _) in enumerate(workload.CANDIDATES)], "idx, qid, i", "x")
_FACTS = f"(SELECT j.idx, j.pred_status, j.n_rows, j.correct, p.* FROM ({_judged_sql()}) j JOIN {_IDX} ON j.idx = x.idx JOIN {_PAIRS} p ON p.qid = x.qid AND p.i = x.i)"


def _facts(spark, sf_dir):
    return _judged(spark, sf_dir).drop("error").join(_numbered(spark), "idx")


@query(
    "exec_accuracy",
    f"""WITH f AS {_FACTS}, g AS (SELECT 'overall' AS level, '' AS "key", sum(correct::INT) AS correct, count(*) AS total FROM f UNION ALL SELECT 'difficulty', d, coalesce(sum(correct::INT), 0), count(correct) FROM (VALUES ('simple'), ('moderate'), ('challenging')) AS v(d) LEFT JOIN f ON f.difficulty = d GROUP BY d UNION ALL SELECT 'database', db_id, sum(correct::INT), count(*) FROM f GROUP BY db_id)
SELECT level, "key", CAST(correct AS BIGINT) AS correct, total, round(correct / greatest(total, 1), 4) AS accuracy FROM g""",
)
def _(spark, sf_dir):
    return evaluate.accuracy(_facts(spark, sf_dir))


@query("scalar_accuracy", f"SELECT round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM {_FACTS}")
def _(spark, sf_dir):
    return evaluate.scalar_accuracy(_facts(spark, sf_dir))


_DIFFERENCES = workload.values([(q, i, k) for (q, i), k in workload.DIFFERENCES.items()], "qid, i, kind", "d")


@query(
    "error_taxonomy",
    f"""WITH f AS (SELECT a.idx, CASE WHEN pred_status <> 'ok' THEN 'syntax_error' WHEN n_rows = 0 THEN 'empty_result' ELSE coalesce(d.kind, 'other') END AS kind FROM {_FACTS} a LEFT JOIN {_DIFFERENCES} ON a.qid = d.qid AND a.i = d.i WHERE NOT correct)
SELECT k.kind, count(idx) AS n, coalesce(array_to_string(list_sort(list(idx))[1:3], ','), '') AS examples FROM (VALUES {', '.join(f"('{k}')" for k in evaluate.ERRORS)}) AS k(kind) LEFT JOIN f ON f.kind = k.kind GROUP BY k.kind""",
)
def _(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return evaluate.error_taxonomy(f.select("idx", "correct", F.col("pred_status").alias("status"), "n_rows", F.col("sql").alias("pred_sql"), F.col("gold").alias("gold_sql")))


@query(
    "method_comparison",
    f"""WITH f AS (SELECT qid, i, difficulty, correct FROM {_FACTS} WHERE i <= 1)
SELECT 'm' || i AS method, round(avg(correct::INT), 4) AS overall, coalesce(round(avg(CASE WHEN difficulty = 'simple' THEN correct::INT END), 4), 0) AS simple, coalesce(round(avg(CASE WHEN difficulty = 'moderate' THEN correct::INT END), 4), 0) AS moderate, coalesce(round(avg(CASE WHEN difficulty = 'challenging' THEN correct::INT END), 4), 0) AS challenging FROM f GROUP BY i""",
)
def _(spark, sf_dir):
    f = _facts(spark, sf_dir).filter("i <= 1").withColumn("method", F.concat(F.lit("m"), F.col("i").cast("string")))
    return evaluate.compare_methods(f)


@query("method_disagreements", f"WITH f AS (SELECT qid, i, correct FROM {_FACTS}) SELECT a.qid AS idx, a.correct AS correct_a, b.correct AS correct_b FROM f a JOIN f b ON a.qid = b.qid AND a.i = 0 AND b.i = 1 WHERE a.correct <> b.correct")
def _(spark, sf_dir):
    f = _facts(spark, sf_dir).select(F.col("qid").alias("idx"), F.concat(F.lit("m"), F.col("i").cast("string")).alias("method"), "correct")
    return evaluate.disagreements(f, "m0", "m1")


@query("result_multiset", "WITH a AS (SELECT o_orderpriority AS p, round(o_totalprice, 0) AS t FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderpriority AS p, round(o_totalprice, 0) AS t FROM orders WHERE o_totalprice < 200000) SELECT lower(p) AS c0, t AS c1, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2 HAVING sum(n) <> 0")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cols = [F.col("o_orderpriority"), F.round("o_totalprice", 0)]
    return compare.multiset_differs(o.filter("o_orderstatus = 'F'").select(*cols), o.filter("o_totalprice < 200000").select(*cols))


def _scored(spark, sf_dir):
    return _facts(spark, sf_dir).withColumn("score", text.result_score(F.col("pred_status"), F.col("n_rows"), F.col("sql"), F.col("question")))


_COUNT_LIST = " OR ".join(f"lower(question) LIKE '%{w}%'" for w in text.COUNT_OR_LIST)
_SPECIFIC = " OR ".join(f"lower(question) LIKE '%{w}%'" for w in text.SPECIFIC)
_SCORE = f"CASE WHEN pred_status <> 'ok' THEN 0.0 ELSE 10 + CASE WHEN n_rows > 0 THEN 5 WHEN {_COUNT_LIST} THEN -2 ELSE 0 END + CASE WHEN n_rows BETWEEN 1 AND 1000 THEN 3 ELSE 0 END + CASE WHEN n_rows > 10000 AND ({_SPECIFIC}) THEN -2 ELSE 0 END + CASE WHEN upper(sql) LIKE 'SELECT%' THEN 2 ELSE 0 END END"


@query("result_score", f"SELECT qid, i, CAST({_SCORE} AS DOUBLE) AS score FROM {_FACTS}")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select("qid", "i", "score")


@query("tournament", f"WITH c AS (SELECT qid, i, CAST({_SCORE} AS DOUBLE) AS score FROM {_FACTS}), w AS (SELECT a.qid, CASE WHEN a.score >= b.score THEN a.i ELSE b.i END AS i, count(*) AS wins FROM c a JOIN c b ON a.qid = b.qid AND a.i < b.i GROUP BY 1, 2) SELECT c.qid, c.i, coalesce(wins, 0) AS wins, score FROM c LEFT JOIN w ON c.qid = w.qid AND c.i = w.i QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY coalesce(wins, 0) DESC, score DESC, c.i) = 1")
def _(spark, sf_dir):
    return vote.tournament(_scored(spark, sf_dir).select("qid", "i", "score"))


@query("majority_vote", "WITH c AS (SELECT user_id AS qid, event_id AS i, event_type AS k FROM events), g AS (SELECT qid, k, count(*) AS votes, min(i) AS i FROM c GROUP BY 1, 2) SELECT qid, i, votes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, i) AS r FROM g) WHERE r = 1")
def _(spark, sf_dir):
    return vote.majority(read(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("i"), F.col("event_type").alias("key")))


def _key_sql(sql: str, width: int) -> str:
    """A result as one digest of its sorted rows of texts, numbers to four digits."""
    cells = " || '|' || ".join(f"coalesce(CASE WHEN typeof(c{c}) IN ('DOUBLE', 'FLOAT') THEN printf('%.4f', c{c}) ELSE lower(trim(CAST(c{c} AS VARCHAR))) END, '')" for c in range(width))
    return f"(SELECT coalesce(md5(string_agg({cells}, ';' ORDER BY {cells})), '__EMPTY__') FROM ({sql}) AS t({', '.join(f'c{c}' for c in range(width))}))"


def _votes_sql() -> str:
    """The key of each candidate's result; failed ones have the key of failures."""
    parts = []
    for q, i, s in workload.CANDIDATES:
        key = "'__ERROR__'" if (q, i) in workload.BROKEN else _key_sql(s, 1 if (q, i) in workload.NARROW else workload.WIDTHS[q])
        parts.append(f"SELECT {q} AS qid, {i} AS i, {key} AS k")
    return " UNION ALL ".join(parts)


@query(
    "majority_of_candidates",
    f"""WITH c AS ({_votes_sql()}), g AS (SELECT qid, k, count(*) AS votes, min(i) AS i FROM c WHERE k <> '__ERROR__' GROUP BY qid, k),
b AS (SELECT qid, i, votes FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, i) = 1)
SELECT m.qid, CAST(coalesce(b.i, m.i) AS BIGINT) AS i, coalesce(b.votes, 0) AS votes FROM (SELECT qid, min(i) AS i FROM c GROUP BY qid) m LEFT JOIN b ON m.qid = b.qid""",
)
def _(spark, sf_dir):
    _registered(spark, sf_dir)
    keys = execute.fingerprints(spark, (s for _, _, s in workload.CANDIDATES), seconds=None)
    rows = [(q, i, keys[s].key) for q, i, s in workload.CANDIDATES]
    return vote.majority(spark.createDataFrame(rows, "qid int, i int, key string"))


_ASKS = lambda words: "(" + " OR ".join(f"lower(question) LIKE '%{w}%'" for w in words) + ")"


@query(
    "suspicious_results",
    f"""SELECT qid, i, reason FROM (SELECT qid, i, CASE WHEN pred_status <> 'ok' THEN 'no result' WHEN n_rows = 0 AND {_ASKS(text.COUNT_WORDS)} THEN 'empty result for a count' WHEN n_rows = 0 AND {_ASKS(text.LIST_WORDS)} THEN 'empty result for a list'
WHEN n_rows > {text.MANY_ROWS} AND {_ASKS(text.SPECIFIC)} THEN 'too many rows for a specific question' END AS reason FROM {_FACTS}) WHERE reason IS NOT NULL""",
)
def _(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return f.select("qid", "i", text.suspicion(F.col("pred_status"), F.col("n_rows"), F.col("question")).alias("reason")).filter("reason IS NOT NULL")


_BROKEN_FORMS = [(1, "SELECT COUNT(*) FROM customer"), (2, "SELECT MAX(s_acctbal FROM supplier"), (3, "SELECT n_name FROM nation)"), (4, "SELECT COUNT(*) FROM (SELECT n_name FROM nation")]


@query("refined_queries", "SELECT * FROM (VALUES (1, 'ok', 0), (2, 'error', 2), (3, 'ok', 1), (4, 'ok', 1)) AS r(qid, status, rounds)")
def _(spark, sf_dir):
    _registered(spark, sf_dir)
    return execute.refine(spark, spark.createDataFrame(_BROKEN_FORMS, "qid int, sql string"), "qid", "sql", 2, seconds=None).select("qid", "status", "rounds")


def _verified_sql() -> str:
    """Of the mutants that run, in the seeded order, the first one with another result."""
    gold = {q: g for q, *_, g in workload.QUESTIONS}
    parts = []
    for (q, name), (old, new) in workload.MUTANTS.items():
        order = hashlib.md5(f"{q}{name}".encode()).hexdigest()
        parts.append(f"SELECT {q} AS qid, '{name}' AS error_type, '{order}' AS o, {_key_sql(gold[q], workload.WIDTHS[q])} <> {_key_sql(gold[q].replace(old, new, 1), workload.WIDTHS[q])} AS differs")
    return f"SELECT qid, arg_min(error_type, o) AS error_type FROM ({' UNION ALL '.join(parts)}) WHERE differs GROUP BY qid"


@query("verified_mutations", _verified_sql())
def _(spark, sf_dir):
    _registered(spark, sf_dir)
    return execute.mutated(spark, workload.questions(spark), "qid", "gold", None).select("qid", "error_type")


def _previewed_sql() -> str:
    one = "SELECT {n} AS idx, {q} AS qid, '{status}' AS status, {total} AS total, least(3, {total}) AS shown"
    return " UNION ALL ".join(one.format(n=n, q=q, status="error" if (q, i) in workload.BROKEN else "ok", total="0" if (q, i) in workload.BROKEN else f"(SELECT count(*) FROM ({s}))") for n, (q, i, s) in enumerate(workload.CANDIDATES))


@query("result_previews", _previewed_sql())
def _(spark, sf_dir):
    _registered(spark, sf_dir)
    texts = spark.createDataFrame([(n, q, s) for n, (q, _, s) in enumerate(workload.CANDIDATES)], "idx int, qid int, sql string")
    got = execute.previews(spark, texts, "idx", "sql", seconds=None).join(texts.select("idx", "qid"), "idx")
    return got.select("idx", "qid", "status", "total", F.size(F.from_json("preview", "array<array<string>>")).cast("long").alias("shown"))


@query("rewards", f"SELECT f.qid, f.i, round(CAST(CASE WHEN pred_status <> 'ok' THEN 0.0 WHEN correct THEN 1.0 ELSE 0.1 END + CASE WHEN tables = gold_tables THEN 0.05 ELSE 0 END AS DOUBLE), 4) AS reward FROM {_FACTS} f JOIN {_NAMED} ON f.qid = t.qid AND f.i = t.i")
def _(spark, sf_dir):
    r = reward.reward(F.col("pred_status"), F.col("correct"), F.lit(True), F.col("sql"), F.col("gold"))
    return _facts(spark, sf_dir).select("qid", "i", F.round(r, 4).alias("reward"))


@query("group_advantage", "SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-8), 4) AS advantage FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id)")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", "user_id", "value")
    return reward.advantages(e, "user_id", "value").select("event_id", F.round("advantage", 4).alias("advantage"))


@query("group_metrics", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return reward.group_metrics(read(spark, sf_dir, "events"), "user_id", "value")


@query("informative_groups", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING min(round(value / 50)) < max(round(value / 50)))")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") / 50).alias("r"))
    return reward.informative(e, "user_id", "r").select("event_id")


@query("diversity", "SELECT user_id, count(*) AS n, round(count(DISTINCT lower(trim(coalesce(event_type, '')))) / count(*), 6) AS diversity, round(count(DISTINCT lower(trim(coalesce(event_type, '')))) / count(*), 6) < 0.3 AS collapsed FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return reward.diversity(read(spark, sf_dir, "events"), "user_id", "event_type")


@query("mean_diversity", "SELECT coalesce(round(avg(d), 6), 1.0) AS mean_diversity FROM (SELECT round(count(DISTINCT lower(trim(coalesce(event_type, '')))) / count(*), 6) AS d FROM events GROUP BY user_id)")
def _(spark, sf_dir):
    return reward.mean_diversity(reward.diversity(read(spark, sf_dir, "events"), "user_id", "event_type"))


_MICRO = "CAST(round(value * 1000000) AS BIGINT)"


def _mean_sql(total: str, n: str) -> str:
    """A mean of whole millionths to four digits, halves up, in integers."""
    return f"CASE WHEN {n} > 0 THEN CAST(floor(({total} * 2 + 100 * {n}) // (200 * {n})) AS BIGINT) / 10000.0 END"


@query("trailing_mean", f"SELECT event_id, {_mean_sql('t', 'n')} AS trailing_mean FROM (SELECT event_id, CAST(sum({_MICRO}) OVER w AS HUGEINT) AS t, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))")
def _(spark, sf_dir):
    e = reward.trailing_mean(read(spark, sf_dir, "events"), "event_id", "value", 100, "event_type")
    return e.select("event_id", F.round("trailing_mean", 4).cast("double").alias("trailing_mean"))


@query("running_mean", f"SELECT event_id, {_mean_sql('t', 'n')} AS running_mean FROM (SELECT event_id, CAST(sum({_MICRO}) OVER w AS HUGEINT) AS t, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))")
def _(spark, sf_dir):
    return reward.running_mean(read(spark, sf_dir, "events"), "event_id", "value", "user_id").select("event_id", F.round("running_mean", 4).cast("double").alias("running_mean"))


@query("batch_timings", "SELECT count(*) AS n, round(sum(p_size / 10.0), 3) AS total, round(sum(p_size / 10.0) / count(*), 3) AS mean FROM part")
def _(spark, sf_dir):
    return reward.timings(read(spark, sf_dir, "part").select((F.col("p_size") / 10.0).alias("s")), "s")


@query("last_steps", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000")
def _(spark, sf_dir):
    return reward.last_steps(read(spark, sf_dir, "events").select("event_id"), "event_id", 1000)


@query("reward_histogram", "SELECT CAST(least(greatest(floor(value / 10.0), 0), 9) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return reward.histogram(read(spark, sf_dir, "events"), "value", 0.0, 100.0, 10)


@query("streamed_rollup", f"SELECT user_id, count(*) AS n, {_mean_sql(f'CAST(sum({_MICRO}) AS HUGEINT)', 'count(value)')} AS mean FROM events GROUP BY user_id")
def _(spark, sf_dir):
    from .streaming import rollups

    return rollups.merged(rollups.windowed(read(spark, sf_dir, "events"), "ts", "user_id", "value", "1 day"), "user_id")


# SQL surface that stored queries use; each text runs on both engines

_SHARED = {
    "join_gold_2way": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "join_gold_3way": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT s_suppkey, count(n_nationkey) AS n FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey GROUP BY s_suppkey",
    "join_full": "SELECT coalesce(a.p_size, b.k) AS k, count(a.p_size) AS n FROM part a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.p_size = b.k GROUP BY coalesce(a.p_size, b.k)",
    "join_cross": "SELECT r_name, count(*) AS n FROM region CROSS JOIN nation GROUP BY r_name",
    "join_natural": "SELECT r_name, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) GROUP BY r_name",
    "join_using": "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders) JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) USING (k) GROUP BY k",
    "join_theta": "SELECT a.n_name AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_name",
    "subquery_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "subquery_exists": "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "subquery_in": "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "cte_recursive": "WITH RECURSIVE t(n, total) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, total + n_regionkey FROM t JOIN nation ON n_nationkey = n + 5) SELECT n, total FROM t",
    "group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS q, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "group_rollup": "SELECT coalesce(c_mktsegment, 'all') AS segment, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderpriority",
    "agg_minmax_by": "SELECT p_brand, min(p_retailprice) AS lo, min(p_partkey) AS k FROM part GROUP BY p_brand",
    "window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders",
    "set_operations": "SELECT 'both' AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)",
    "sort_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "case_strings": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS size, upper(substring(p_name, 1, 3)) || replace(p_brand, '#', '-') AS tag FROM part",
}


def _shared(name: str, sql: str) -> None:
    @query(f"sql_{name}", sql)
    def _(spark, sf_dir):
        _registered(spark, sf_dir)
        return spark.sql(sql)


for _name, _sql in _SHARED.items():
    _shared(_name, _sql)


@query("sql_json_extract", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v FROM events WHERE props IS NOT NULL")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("props IS NOT NULL")
    return e.select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("v"))


@query("min_by_row", "SELECT arg_min(c_name, (c_acctbal, c_custkey)) AS poorest, min(c_acctbal) AS balance FROM customer")
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").agg(F.min_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("poorest"), F.min("c_acctbal").alias("balance"))


_RATES = [(24, 800), (40, 1200), (48, 1500), (80, 2500)]  # fixed values: memory, samples an hour of the smaller model


@query("nearest_bracket", f"SELECT p_partkey, arg_min(rate, (abs(mem - p_size), mem)) AS rate FROM part, {workload.values(_RATES, 'mem, rate', 'b')} GROUP BY p_partkey")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", stats.rate(F.col("p_size"), "7B").alias("rate"))


@query("training_hours", f"SELECT p_partkey, CASE WHEN h < 1 THEN '~' || CAST(floor(h * 60) AS BIGINT) || ' minutes' WHEN h < 24 THEN printf('~%.1f hours', h) ELSE printf('~%.1f days', h / 24) END AS shown FROM (SELECT p_partkey, 60000.0 / arg_min(rate, (abs(mem - p_size), mem)) AS h FROM part, {workload.values(_RATES, 'mem, rate', 'b')} GROUP BY p_partkey)")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", stats.hours(F.col("p_size"), "7B").alias("shown"))


@query("positional_join", "SELECT a.r AS idx, a.o_orderkey, b.c_name FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey FROM orders) a JOIN (SELECT row_number() OVER (ORDER BY c_custkey) AS r, c_name FROM customer) b ON a.r = b.r")
def _(spark, sf_dir):
    left = ranks.numbered(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return evaluate.positional(left, ranks.numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("idx", "c_name"))


@query("reasoning_steps", f"SELECT {generated.steps_sql()} || chr(10) || chr(10) || 'SQL: ' || {generated.GOLD_SQL} AS answer FROM part WHERE {generated.FORM} BETWEEN 1 AND 3")
def _(spark, sf_dir):
    from .plans import dataset

    q = _samples(spark, sf_dir).select("db_id", "question", "evidence", F.col("gold").alias("SQL"), F.lit("").alias("schema_text"))
    return dataset.reasoning(q).select(text.last_of(F.col("messages"), "assistant").alias("answer"))


@query(
    "dataset_records",
    f"SELECT t AS task_type, db_id, count(*) AS n FROM (SELECT *, {generated.FORM} AS form FROM {generated.SAMPLES_SQL}), (VALUES ('text2sql'), ('schema_linking'), ('skeleton_extraction'), ('chain_of_thought')) AS b(t) WHERE CASE t WHEN 'skeleton_extraction' THEN form < 4 WHEN 'chain_of_thought' THEN form BETWEEN 1 AND 3 ELSE true END GROUP BY t, db_id",
)
def _(spark, sf_dir):
    from .plans import dataset

    q = _samples(spark, sf_dir).select("db_id", "question", "evidence", F.col("gold").alias("SQL"), F.lit("").alias("schema_text"))
    return dataset.assemble(q).groupBy("task_type", "db_id").agg(F.count(F.lit(1)).alias("n"))


# Records for training, predictions, collections


def _chats(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    lists = c.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"], x["content"])).alias("messages"))
    kinds = F.array(*map(F.lit, ("text2sql", "schema_linking", "chain_of_thought")))
    return lists.select("conv_id", "messages", F.element_at(kinds, (F.col("conv_id") % 3 + 1).cast("int")).alias("task_type"), F.when(F.col("conv_id") % 2 == 0, "ddl").alias("schema_type"), F.lit("sales").alias("db_id"))


@query("chosen_records", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND conv_id % 3 <> 1 AND conv_id % 2 = 0")
def _(spark, sf_dir):
    from .plans import training

    return training.chosen_records(_chats(spark, sf_dir), [" text2sql", "chain_of_thought "], ["ddl", "light"]).select("conv_id")


@query("training_texts", "SELECT md5(t) AS digest, count(*) AS n FROM (SELECT string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id) GROUP BY 1")
def _(spark, sf_dir):
    from .plans import training

    return training.texts(_chats(spark, sf_dir)).groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("rl_prompts", f"SELECT '{text.SYSTEM_MESSAGES['text2sql']}' AS system, 'Database Schema:' || chr(10) || '-- Schema for database: ' || db_id || ' (not available)' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || CASE WHEN trim(evidence) <> '' THEN 'Evidence: ' || evidence || chr(10) || chr(10) ELSE '' END || 'Generate the SQL query.' AS \"user\", db_id, gold AS gold_sql FROM {generated.SAMPLES_SQL} UNION ALL SELECT '{text.SYSTEM_MESSAGES['text2sql']}', question, db_id, gold FROM {generated.SAMPLES_SQL}")
def _(spark, sf_dir):
    from .plans import training

    q = _samples(spark, sf_dir)
    chats = q.select(text.chat("text2sql", F.col("question"), F.concat(F.lit("```sql\n"), "gold", F.lit("\n```"))).alias("messages"), "db_id")
    dead = chats.select(F.filter("messages", lambda m: m["role"] != "user").alias("messages"), "db_id")
    raw = q.select("question", F.col("gold").alias("SQL"), "db_id", "evidence")
    empty = raw.withColumn("question", F.lit(""))
    return training.prompts(chats.unionByName(dead), raw.unionByName(empty))


@query("exec_or_exact", f"SELECT avg(CASE WHEN qid <= 5 THEN correct::INT END) AS accuracy FROM {_FACTS}")
def _(spark, sf_dir):
    f = _facts(spark, sf_dir).select((F.col("qid") <= 5).alias("valid_db"), "correct", (text.normalised_sql(F.col("sql")) == text.normalised_sql(F.col("gold"))).alias("exact"))
    return evaluate.accuracy_or_exact(f)


@query("predictions", f"SELECT qid, selected_method, n FROM (SELECT w.qid, CASE WHEN w.qid = 11 THEN 'error' ELSE 'tournament' END AS selected_method, CAST(CASE WHEN w.qid = 11 THEN 0 ELSE 2 END AS BIGINT) AS n FROM {workload.QUESTIONS_SQL})")
def _(spark, sf_dir):
    from .plans import predict

    _registered(spark, sf_dir)
    given = workload.candidates(spark).filter("i = 1").select(F.col("qid").alias("q"), F.concat(F.lit("Answer: "), "sql").alias("reply"))
    gold = workload.questions(spark).select("qid", F.col("gold").alias("reply"))
    second = lambda q: q.select("qid").join(given, F.col("qid") == F.col("q"), "left").select("qid", F.coalesce("reply", F.lit("SELECT 1")).alias("reply"))
    asked = workload.questions(spark).select("qid", F.when(F.col("qid") < 11, F.col("question")).otherwise("").alias("question"), "db_id", "evidence")
    out = predict.Predictor(spark, [lambda q: q.select("qid").join(gold, "qid"), second]).predict_batch(asked)
    return out.select("qid", "selected_method", F.size("candidates").cast("long").alias("n"))


def _letters(value):
    """A stand-in for an embedding model: how often each of a few letters occurs."""
    return F.array(*(F.length(F.regexp_replace(F.lower(value), f"[^{c}]", "")).cast("double") for c in "aeinorst"))


_LETTERS = "[" + ", ".join(f"length(regexp_replace(lower({{0}}), '[^{c}]', '', 'g'))::DOUBLE" for c in "aeinorst") + "]"


@query(
    "cell_search",
    f"WITH e AS (SELECT DISTINCT n_name AS value, {_LETTERS.format('n_name')} AS v FROM nation), q AS (SELECT r_name AS qid, {_LETTERS.format('r_name')} AS v FROM region) "
    f"SELECT qid, e.value, round({_COSINE}, 6) AS distance FROM q, e WHERE {_COSINE} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_COSINE}, md5('nation' || chr(1) || 'n_name' || chr(1) || e.value)) <= 3",
)
def _(spark, sf_dir):
    entries = collections.cells({"nation": read(spark, sf_dir, "nation").select("n_name")}, _letters)
    asked = read(spark, sf_dir, "region").select(F.col("r_name").alias("qid"), F.col("r_name").alias("text"))
    return collections.hits(entries, asked, _letters, 3).join(entries.select("id", F.col("document").alias("value")), "id").select("qid", "value", F.round("distance", 6).alias("distance"))


@query(
    "stored_collection",
    f"WITH e AS {_VECTORS}, q AS (SELECT * FROM e WHERE id % 100 = 0), d AS (SELECT q.id AS qid, e.id, {_COSINE} AS distance FROM q JOIN e ON e.label = q.label AND e.id <> q.id) "
    "SELECT qid, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM d WHERE distance IS NOT NULL QUALIFY rank <= 5",
)
def _(spark, sf_dir):
    """A collection that is built, appended to (entries that are there stay), and searched within labels."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    folder = files.passing_folder(spark, "collection")
    collections.append(e.filter("id % 3 <> 0"), folder, by="label")
    collections.append(e, folder, by="label")
    asked = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("part"))
    return collections.search(spark, folder, asked, 5, same=True).withColumn("distance", F.round("distance", 6))


@query("answer_store", "SELECT doc_id, sha256(text) AS key, CAST(length(text) AS INTEGER) AS answer, 1 AS stored FROM documents WHERE text IS NOT NULL")
def _(spark, sf_dir):
    """Two runs that answer the same keys beside each other: the second commits while the first is about to."""
    wanted = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "text")
    folder, reply = files.passing_folder(spark, "answers"), lambda df: df.withColumn("answer", F.length("text"))
    later = iter([lambda: store.answered(wanted.filter("doc_id % 3 > 0"), folder, "key", reply)])
    store.answered(wanted.filter("doc_id % 2 = 0"), folder, "key", reply, before=lambda: next(later, lambda: None)())
    found = store.answered(wanted, folder, "key", reply)
    copies = store.rows(spark, folder).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("stored"))
    return found.select("doc_id", "key", "answer").join(copies, "key")


def _messages(spark, sf_dir):
    """conv_id and messages of each conversation, in the order of its turns."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


@query("message_hashes", "SELECT conv_id, sha256('[' || string_agg('{\"content\": ' || CAST(to_json(text) AS VARCHAR) || ', \"role\": ' || CAST(to_json(role) AS VARCHAR) || '}', ', ' ORDER BY turn) || ']') AS hash FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", text.message_hash(F.col("messages")).alias("hash"))


@query("assistant_labels")
def _(spark, sf_dir):
    """Token ids and labels of all conversations in padded batches; SQL has no tokenizer, tests have brute force."""
    import public_tokenizers

    rows = tokens.labelled(_messages(spark, sf_dir), "messages", public_tokenizers.path("byte_bpe_50k.json"), training.templated).select("conv_id", "ids", "labels")
    return tokens.batched(rows, "conv_id", 8, pad=50256).select("conv_id", "batch", "ids", "labels", "mask")


@query("positional_lines", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS idx FROM customer) SELECT o.idx, o_orderkey, c_custkey, c_name FROM o JOIN c ON o.idx = c.idx")
def _(spark, sf_dir):
    """Two files of lines without a key, joined by the places of their lines."""
    left, right = files.passing_folder(spark, "lines"), files.passing_folder(spark, "lines")
    files.write_lines(read(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey"), left)
    files.write_lines(read(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy(F.desc("c_name"), "c_custkey"), right)
    return files.read_numbered(spark, left, "o_orderkey long").join(files.read_numbered(spark, right, "c_custkey long, c_name string"), "idx")


def _letter_model():
    """Stands for a model: the number of letters of a text; it can't answer long texts."""

    def model(texts: list[str]) -> list[str]:
        for t in texts:
            if len(t) > 600:
                raise ValueError("text is too long")
        return [str(sum(c.isascii() and c.isalpha() for c in t)) for t in texts]

    return model


@query("model_replies", "SELECT conv_id, turn, CASE WHEN length(text) <= 600 THEN CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS VARCHAR) END AS reply, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) > 600 THEN 'ValueError: text is too long' END AS error FROM conversations")
def _(spark, sf_dir):
    answered = read(spark, sf_dir, "conversations").select("conv_id", "turn", models.call(F.col("text"), "letters", _letter_model, tries=2, wait=0.0).alias("r"))
    return answered.select("conv_id", "turn", F.col("r.value").alias("reply"), F.col("r.error").alias("error"))


@query(
    "streamed_means",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(round(1000000.0 * count(DISTINCT lower(trim(event_type))) / count(*)) AS BIGINT) AS m FROM events GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, sum(m) OVER w / count(*) OVER w / 1000000.0 AS running_mean, sum(m) OVER v / count(*) OVER v / 1000000.0 AS trailing_mean FROM d
WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY user_id ORDER BY day ROWS 2 PRECEDING)""",
)
def _(spark, sf_dir):
    """The diversity of each user's day as a stream that arrives in two parts; the second run goes on from the first one's state."""
    from .streaming import monitors, rollups

    days = read(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list("event_type").alias("responses"))
    middle = days.agg(F.percentile_approx(F.unix_date(F.to_date("day")), 0.5)).first()[0] or 0
    early = F.unix_date(F.to_date("day")) < middle
    source, out, state = (files.passing_folder(spark, n) for n in ("stream", "means", "state"))
    for part in (days.filter(early), days.filter(~early)):
        part.write.mode("append").parquet(source)
        stream = rollups.read(spark, source, "user_id bigint, day string, responses array<string>")
        checks = stream.select("user_id", "day", monitors.group_diversity(F.col("responses")).alias("diversity"))
        rollups.drained(monitors.means(checks, "user_id", "day", "diversity", 3), out, state)
    return spark.read.parquet(out)


#: Answers to "How many parts of brand B are there?" by the brand's number: right, broken but mendable by rules, broken
#: beyond them, empty, about another brand, and beyond repair.
_REPAIR_CASES = {
    0: "SELECT COUNT(*) FROM part WHERE p_brand = '{b}'", 1: "SELECT COUNT(*) FROM (SELECT p_name FROM part WHERE p_brand = '{b}'", 2: "SELECT COUNT(p_nothing) FROM part WHERE p_brand = '{b}'",
    3: "SELECT p_name FROM part WHERE p_brand = '{b}' AND p_size < 0", 4: "SELECT COUNT(*) FROM part WHERE p_brand = 'other'", 5: "SELECT COUNT(lost) FROM part WHERE p_brand = '{b}'",
}


def _repairs_sql() -> str:
    case = " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''").replace("{b}", "' || p_brand || '") + (");" if k == 1 else "")) for k, v in _REPAIR_CASES.items() if k in (0, 1, 5))
    right = _REPAIR_CASES[0].replace("'", "''").replace("{b}", "' || p_brand || '")
    return f"""WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) % 6 AS k FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL))
SELECT p_brand AS qid, CASE k {case} ELSE '{right}' END AS "SQL", CASE WHEN k = 5 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k IN (0, 5) THEN 0 ELSE 1 END AS rounds, k = 5 AS open FROM b"""


@query("judged_repairs", _repairs_sql())
def _(spark, sf_dir):
    """Questions about each brand with right, broken and doubtful answers, judged and repaired in rounds."""
    _registered(spark, sf_dir)
    brands = ranks.numbered(read(spark, sf_dir, "part").select("p_brand").filter("p_brand IS NOT NULL").distinct(), "p_brand", "n")
    cases = F.create_map(*(x for k, v in _REPAIR_CASES.items() for x in (F.lit(k), F.lit(v))))
    samples = brands.select(
        F.col("p_brand").alias("qid"), F.concat(F.lit("How many parts of brand "), "p_brand", F.lit(" are there?")).alias("question"), F.lit("sales").alias("db_id"), F.lit("CREATE TABLE part (p_brand VARCHAR)").alias("schema_text"),
        F.replace(cases[(F.col("n") % 6).cast("int")], F.lit("{b}"), F.col("p_brand")).alias("SQL"),
    )
    brand = F.regexp_extract("prompt", r"parts of brand (.*) are there", 1)
    fits, other = '{"valid": true, "confidence": 0.9, "reason": "fits"}', '```json\n{"valid": false, "confidence": 0.9, "reason": "another brand"}\n```'
    judge = lambda df: df.select("key", F.when(F.col("prompt").contains(F.concat(F.lit("p_brand = '"), brand, F.lit("'"))), fits).otherwise(other).alias("reply"))
    fix = lambda df: df.select("key", F.when(F.col("prompt").contains("COUNT(lost)"), "").otherwise(F.concat(F.lit("```sql\nSELECT COUNT(*) FROM part WHERE p_brand = '"), brand, F.lit("'\n```"))).alias("reply"))
    done = repair.repair(samples, files.passing_folder(spark, "repair"), judge, fix, rounds=2, seconds=None)
    return done.select("qid", "SQL", "status", "rounds", F.col("issue").isNotNull().alias("open"))
