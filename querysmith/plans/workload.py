"""A small workload of questions and queries over the sales tables, standing in for a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: qid, db_id, difficulty, question, evidence, gold query.
QUESTIONS = [
    (1, "sales", "simple", "How many customers are there?", "", "SELECT COUNT(*) AS n FROM customer"),
    (2, "sales", "simple", "List all market segments.", "", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment"),
    (3, "sales", "simple", "Which nations are in region 1?", "region 1 is America", "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name"),
    (4, "sales", "moderate", "How many orders has each segment?", "", "SELECT c.c_mktsegment, COUNT(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment"),
    (5, "sales", "moderate", "What is the average price of part 'Brand#12'?", "", "SELECT AVG(p_retailprice) AS avg_price FROM part WHERE p_brand = 'Brand#12' AND p_size > 10"),
    (6, "sales", "moderate", "Which suppliers have a negative balance?", "", "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < 0 ORDER BY s_acctbal ASC LIMIT 5"),
    (7, "sales", "challenging", "What is the revenue of each nation?", "revenue is price times one minus discount", "SELECT n.n_name, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY revenue DESC"),
    (8, "sales", "challenging", "Who has more than the average balance?", "", "SELECT c_name FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer) AND c_nationkey = 3"),
    (9, "sales", "simple", "Count the orders of status F since 1995.", "", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    (10, "events", "moderate", "Which event types occur most?", "", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3"),
    (11, "sales", "moderate", "Which supplier is the oldest?", "", "SELECT s_name FROM supplier ORDER BY s_birthday LIMIT 1"),
]
#: Questions whose gold query doesn't run, candidates that don't, columns of results, and candidates with one column instead of two.
BROKEN_GOLD, BROKEN, NARROW = {11}, {(1, 2), (9, 1), (11, 0)}, {(6, 1)}
WIDTHS = {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 2, 7: 2, 8: 1, 9: 1, 10: 2, 11: 1}
#: qid, candidate number, query: right ones, wrong ones and broken ones.
CANDIDATES = [
    (1, 0, "SELECT COUNT(c_custkey) AS n FROM customer"), (1, 1, "SELECT COUNT(*) FROM customer"), (1, 2, "SELECT COUNT(*) FROM customers"),
    (2, 0, "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment"), (2, 1, "SELECT c_mktsegment FROM customer"),
    (3, 0, "SELECT n_name FROM nation WHERE n_regionkey = 2"), (3, 1, "SELECT n_name FROM nation WHERE n_regionkey = 1"), (3, 2, "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC"),
    (4, 0, "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment"), (4, 1, "SELECT c.c_mktsegment, COUNT(o.o_orderkey) FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment"),
    (5, 0, "SELECT MAX(p_retailprice) FROM part WHERE p_brand = 'Brand#12' AND p_size > 10"), (5, 1, "SELECT AVG(p_retailprice) FROM part WHERE p_brand = 'Brand#12' AND p_size > 10"),
    (6, 0, "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < 0 ORDER BY s_acctbal LIMIT 5"), (6, 1, "SELECT s_name FROM supplier WHERE s_acctbal < -100000"),
    (7, 0, "SELECT n.n_name, SUM(l.l_extendedprice) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"),
    (8, 0, "SELECT c_name FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3"), (8, 1, "SELECT c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer)"),
    (9, 0, "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O'"), (9, 1, "SELEC COUNT(*) FROM orders"),
    (10, 0, "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3"), (10, 1, "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY n ASC LIMIT 3"),
    (11, 0, "SELECT s_name FROM supplier ORDER BY s_age DESC LIMIT 1"), (11, 1, "SELECT s_name FROM supplier WHERE s_suppkey = 1"),
]
#: Tables of the gold queries; candidates name the same ones but for those listed.
TABLES = {1: "customer", 2: "customer", 3: "nation", 4: "customer,orders", 5: "part", 6: "supplier", 7: "customer,lineitem,nation,orders", 8: "customer", 9: "orders", 10: "events", 11: "supplier"}
OTHER_TABLES = {(1, 2): "customers", (4, 0): "customer"}
#: The first kind of difference of a candidate that runs, has rows and isn't right: columns, filter, join, aggregation, or other.
DIFFERENCES = {(1, 0): "wrong_columns", (2, 1): "wrong_columns", (3, 0): "wrong_filter", (4, 0): "wrong_columns", (4, 1): "wrong_columns", (5, 0): "wrong_columns", (7, 0): "wrong_columns", (8, 0): "wrong_columns", (9, 0): "wrong_columns", (6, 1): "wrong_columns", (1, 1): "wrong_columns", (5, 1): "wrong_columns"}
#: Mutations of the gold queries that run, as the text that each replaces and what it puts there, worked out by hand.
MUTANTS = {
    (1, "missing_distinct"): ("SELECT", "SELECT DISTINCT"), (2, "missing_distinct"): ("SELECT DISTINCT", "SELECT"), (2, "wrong_order"): ("BY c_mktsegment", "BY c_mktsegment DESC"),
    (3, "missing_condition"): (" WHERE n_regionkey = 1", ""), (3, "wrong_operator"): ("=", "!="), (3, "missing_distinct"): ("SELECT", "SELECT DISTINCT"), (3, "wrong_order"): ("BY n_name", "BY n_name DESC"),
    (4, "wrong_join_type"): ("JOIN", "LEFT JOIN"), (4, "missing_distinct"): ("SELECT", "SELECT DISTINCT"),
    (5, "wrong_aggregation"): ("AVG", "MIN"), (5, "missing_condition"): (" AND p_size > 10", ""), (5, "wrong_operator"): (">", "<="), (5, "missing_distinct"): ("SELECT", "SELECT DISTINCT"),
    (6, "column_swap"): ("s_name, s_acctbal", "s_acctbal, s_name"), (6, "missing_condition"): (" WHERE s_acctbal < 0", ""), (6, "wrong_operator"): ("<", ">="), (6, "missing_distinct"): ("SELECT", "SELECT DISTINCT"), (6, "wrong_order"): ("ASC", "DESC"),
    (7, "wrong_aggregation"): ("SUM", "AVG"), (7, "wrong_join_type"): ("JOIN", "LEFT JOIN"), (7, "missing_distinct"): ("SELECT", "SELECT DISTINCT"), (7, "wrong_order"): ("DESC", "ASC"),
    (8, "wrong_aggregation"): ("AVG", "MAX"), (8, "missing_condition"): (" AND c_nationkey = 3", ""), (8, "wrong_operator"): (">", "<="), (8, "missing_distinct"): ("SELECT", "SELECT DISTINCT"),
    (9, "missing_condition"): (" WHERE o_orderstatus = 'F'", ""), (9, "wrong_operator"): ("=", "!="), (9, "missing_distinct"): ("SELECT", "SELECT DISTINCT"),
    (10, "missing_distinct"): ("SELECT", "SELECT DISTINCT"), (10, "wrong_order"): ("DESC", "ASC"),
}


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid int, db_id string, difficulty string, question string, evidence string, gold string")


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATES, "qid int, i int, sql string")


def values(rows: list[tuple], names: str, alias: str) -> str:
    """The rows as a VALUES relation of standard SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS {alias}({names})"


QUESTIONS_SQL = values(QUESTIONS, "qid, db_id, difficulty, question, evidence, gold", "w")
CANDIDATES_SQL = values(CANDIDATES, "qid, i, sql", "k")
