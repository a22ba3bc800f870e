"""Samples made from the rows of a table of parts: a question, its query and an answer for each part, in several forms.

Texts and what is known of them are SQL expressions over the row, so that Spark makes the texts and any other engine
can work out the same row's expected facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The form of a part's query, and of the answer to it.
FORM, VARIANT = "p_partkey % 5", "CAST(floor(p_partkey / 5.0) AS BIGINT) % 3"
#: A line break, a size and a quoted name in an SQL expression.
NL, SIZE, NAME = "' || chr(10) || '", "' || p_size || '", "''' || p_name || '''"
GOLD = (
    f"'SELECT COUNT(*) AS n FROM part WHERE p_name = {NAME} AND p_size > {SIZE}'",
    f"'SELECT DISTINCT s.s_name, SUM(l.l_quantity) AS q FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey INNER JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE p.p_partkey = ' || p_partkey || ' GROUP BY s.s_name ORDER BY q DESC LIMIT {SIZE}'",
    f"'SELECT p_name FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part) AND p_name <> {NAME}'",
    f"'SELECT o_orderkey FROM orders NATURAL JOIN customer CROSS JOIN region FULL OUTER JOIN part ON p_size = {SIZE} ORDER BY o_orderkey'",
    "'SELECT p_type AS t_' || p_partkey || ' FROM part ORDER BY p_type'",
)
#: Facts of each form: tables in order of appearance, joins (type, table, condition), and clauses as expressions.
TABLES = (("part",), ("part", "lineitem", "supplier", "nation"), ("part",), ("orders", "customer", "region", "part"), ("part",))
JOINS = (
    (),
    (("JOIN", "lineitem", "'p.p_partkey = l.l_partkey'"), ("LEFT JOIN", "supplier", "'l.l_suppkey = s.s_suppkey'"), ("INNER JOIN", "nation", "'s.s_nationkey = n.n_nationkey'")),
    (),
    (("NATURAL JOIN", "customer", "''"), ("CROSS JOIN", "region", "''"), ("FULL JOIN", "part", f"'p_size = {SIZE}'")),
    (),
)
AGGREGATIONS = ("COUNT(*)", "SUM(l.l_quantity)", "AVG(p_retailprice)", "", "")
CONDITIONS = (f"'p_name = {NAME} AND p_size > {SIZE}'", "'p.p_partkey = ' || p_partkey", f"'p_retailprice > (SELECT AVG(p_retailprice) FROM part) AND p_name <> {NAME}'", "''", "''")
ORDERING, GROUPS = ("", "q DESC", "", "o_orderkey", "p_type"), ("", "s.s_name", "", "", "")
COLUMNS = (
    "part.p_name,part.p_size", "lineitem.l_partkey,lineitem.l_quantity,lineitem.l_suppkey,nation.n_nationkey,part.p_partkey,supplier.s_name,supplier.s_nationkey,supplier.s_suppkey",
    "part.p_name,part.p_retailprice", "orders.o_orderkey,orders.p_size", "part.p_type",
)
#: Answers: the same query in other letters, another SELECT list, one query more.
ANSWERS = ("'  ' || upper({gold}) || '; '", "replace({gold}, 'SELECT ', 'SELECT x, ')", "{gold} || ' UNION SELECT MAX(y) FROM region r JOIN events e ON r.a = e.b'")
#: Replies of a model around a query {q} in the forms that occur, and what is to be read from them.
SHORT = f"'SELECT p_name FROM part WHERE p_size = {SIZE}'"
REPLIES = (
    ("'Here it is:" + NL + "```sql" + NL + "' || {q} || '" + NL + "```" + NL + "Done.'", "{q}"), ("'```" + NL + "' || {q} || '" + NL + "```'", "{q}"), ("'Answer: ' || {q} || '" + NL + NL + "That is all.'", "{q}"),
    ("'[SQL] ' || {q} || ' [/SQL]'", "{q}"), ("'I think SELECT a FROM t; or rather ' || {q} || ' AND p_size > 2; would do'", "{q} || ' AND p_size > 2;'"),
    ("'nothing to read here, part ' || p_partkey", "'nothing to read here, part ' || p_partkey"), (f"'  DELETE FROM part WHERE p_size = {SIZE}; explained'", f"'DELETE FROM part WHERE p_size = {SIZE};'"),
)
#: A judge's replies: a verdict, a fenced one that is too sure, no verdict, one without a reason that is below zero.
SHARE = "'0.' || lpad(CAST(p_size AS VARCHAR(9)), 2, '0')"
VERDICTS = (
    f"'{{\"valid\": true, \"confidence\": ' || {SHARE} || ', \"reason\": \"part ' || p_partkey || '\"}}'", "'```json" + NL + "{\"valid\": false, \"confidence\": ' || p_size || '.5, \"reason\": \"wrong table\"}" + NL + "```'",
    "'I cannot say about ' || p_name", "'{\"valid\": true, \"confidence\": -' || p_size || '}'",
)
#: Broken queries with their errors, and what the rules make of them.
BROKEN = (
    (f"'SELECT ({SIZE}'", "''", f"'SELECT ({SIZE});'"), (f"'SELECT {SIZE}'", "''", f"'SELECT {SIZE};'"),
    ("'SELECT nope_' || p_partkey || ' FROM t;'", "'[UNRESOLVED_COLUMN.WITH_SUGGESTION] A column `nope_' || p_partkey || '` cannot be resolved'", "'SELECT `nope_' || p_partkey || '` FROM t'"), (f"'SELECT {SIZE}) '", "''", f"'SELECT {SIZE}'"),
)


def case(of: str, values, quoted: bool = False) -> str:
    """The expression whose place the number `of` gives; quoted: values are plain texts."""
    show = lambda v: "'" + v.replace("'", "''") + "'" if quoted else str(v)
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"


GOLD_SQL = case(FORM, GOLD)
PRED_SQL = case(VARIANT, [a.replace("{gold}", f"({GOLD_SQL})") for a in ANSWERS])
#: Columns of a sample.
SAMPLE = {
    "qid": "p_partkey", "db_id": "CASE WHEN p_partkey % 7 = 0 THEN 'events' ELSE 'sales' END", "question": "'How many parts are like ' || p_name || ' of size ' || p_size || '?'",
    "evidence": "CASE WHEN p_size % 3 = 0 THEN 'size is ' || p_size WHEN p_size % 3 = 1 THEN ' ' ELSE '' END", "gold": GOLD_SQL, "sql": PRED_SQL, "p_partkey": "p_partkey", "p_size": "p_size", "p_name": "p_name", "p_brand": "p_brand",
}
SAMPLES_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in SAMPLE.items())} FROM part) AS w"


def samples(part: DataFrame) -> DataFrame:
    """A sample for each part: qid, db_id, question, evidence, gold, sql (an answer), and the part's own columns."""
    return part.select(*(F.expr(e).alias(c) for c, e in SAMPLE.items()))


def steps_sql() -> str:
    """The numbered steps of a complex query, by its form (an expression over the row)."""
    out = {}
    for form in (1, 2, 3):
        joins = "; ".join(f"{kind} `{table}`" + ("" if on == "''" else f" ON ' || {on} || '") for kind, table, on in JOINS[form])
        lines = [f"'Identify the relevant tables: {', '.join(f'`{t}`' for t in TABLES[form])}'"]
        lines += [f"'Join the tables: {joins}'"] if joins else []
        lines += [f"'Apply filter conditions: WHERE ' || {CONDITIONS[form]}"] if CONDITIONS[form] != "''" else []
        lines += [f"'{head}{value[form]}'" for head, value in (("Apply aggregation functions: ", AGGREGATIONS), ("Group the results: ", GROUPS), ("Order the results: ", ORDERING)) if value[form]]
        lines += ["'Apply DISTINCT to remove duplicates'"] if form == 1 else ["'Use a subquery to compute an intermediate result'"] if form == 2 else []
        out[form] = " || chr(10) || ".join(f"'{n}. ' || {line}" for n, line in enumerate(lines, 1))
    return f"CASE {FORM} " + " ".join(f"WHEN {k} THEN {v}" for k, v in out.items()) + " END"
