"""A small SQL reader: tokens, nested scopes, and the clauses of each scope. Texts are read, never run.

Parentheses become nested groups first; each group that starts with SELECT or WITH is a scope of its own, and
a scope is cut into branches at set operators and into clauses at its own key words. So strings, comments,
subqueries and functions can't be mistaken for clauses. The functions run over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..session import importable

#: Aggregate functions that the analyses know.
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
TOKEN = re.compile(r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign><>|<=|>=|!=|==|\|\||::|[^\s\w])""", re.S)
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "OFFSET", "WINDOW")
SET_OPERATORS = ("UNION", "INTERSECT", "EXCEPT")
JOIN_WORDS = ("NATURAL", "LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "SEMI", "ANTI")
#: Words that are never column names where they stand bare.
RESERVED = {
    *"SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET WINDOW AS ON USING JOIN AND OR NOT IN IS NULL LIKE ILIKE GLOB BETWEEN EXISTS CASE WHEN THEN ELSE END ASC DESC NULLS FIRST LAST TRUE FALSE".split(),
    *"UNION INTERSECT EXCEPT WITH RECURSIVE VALUES INTERVAL OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW FILTER ESCAPE COLLATE CAST ROLLUP CUBE".split(), *JOIN_WORDS,
}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    inside: list[Token] = field(default_factory=list)  # of a parenthesis

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def bare(self) -> str:
        """The name without its quotes."""
        return self.text[1:-1] if self.kind == "name" else self.text


def tokens(sql: str) -> list[Token]:
    """Tokens of a text, parentheses as nested groups; an unclosed one ends with the text."""
    stack: list[list[Token]] = [[]]
    opened: list[Token] = []
    for m in TOKEN.finditer(sql):
        if m.lastgroup == "skip":
            continue
        token = Token(m.lastgroup or "", m.group(), m.start(), m.end())
        if token.text == "(" and token.kind == "sign":
            group = Token("group", "(", m.start(), len(sql))
            stack[-1].append(group)
            opened.append(group)
            stack.append(group.inside)
        elif token.text == ")" and token.kind == "sign":
            if opened:
                opened.pop().end = m.end()
                stack.pop()
        else:
            stack[-1].append(token)
    return stack[0]


@dataclass
class Source:
    """A table of a FROM clause: its name ('' for a subquery), alias, how it is joined and on what."""

    table: str
    alias: str
    join: str = ""
    on: str = ""


@dataclass
class Branch:
    """One SELECT: its clauses as tokens and the sources of its FROM."""

    clauses: dict[str, list[Token]]
    sources: list[Source]
    nested: bool


def _text(sql: str, part: list[Token]) -> str:
    return " ".join(sql[part[0].start : part[-1].end].split()) if part else ""


def _is_query(group: Token) -> bool:
    return group.kind == "group" and bool(group.inside) and group.inside[0].upper in ("SELECT", "WITH")


def _joins(part: list[Token], i: int) -> bool:
    """Whether a word of a join stands at i: before a parenthesis it is a function (LEFT, RIGHT), in a name's place a name."""
    word = part[i].upper if part[i].kind == "word" else ""
    called = i + 1 < len(part) and part[i + 1].kind == "group" and word != "JOIN" and not _is_query(part[i + 1])
    return (word in JOIN_WORDS or word == "JOIN") and not called and not (i and part[i - 1].text == ".")


def _sources(sql: str, part: list[Token]) -> list[Source]:
    found: list[Source] = []
    i, how = 0, ""
    while i < len(part):
        word = part[i].upper
        if word in JOIN_WORDS and _joins(part, i):
            kinds = []
            while i < len(part) and part[i].upper in JOIN_WORDS:
                kinds.append(part[i].upper)
                i += 1
            how = " ".join([*(k for k in kinds if k != "OUTER"), "JOIN"])
            i += i < len(part) and part[i].upper == "JOIN"
            continue
        if word == "JOIN" or part[i].text == ",":
            how = "JOIN" if word == "JOIN" else ""
            i += 1
            continue
        if word in ("ON", "USING"):
            end = i + 1
            while end < len(part) and part[end].text != "," and not _joins(part, end):
                end += 1
            if found:
                found[-1].on = _text(sql, part[i + 1 : end])
            i = end
            continue
        table = ""
        if part[i].kind in ("word", "name"):
            table = part[i].bare
            while i + 2 < len(part) and part[i + 1].text == ".":  # a qualified name keeps its last part
                table, i = part[i + 2].bare, i + 2
        i += 1
        if i < len(part) and part[i].kind == "group":  # a table function
            i += 1
        alias = ""
        if i < len(part) and part[i].upper == "AS":
            i += 1
        if i < len(part) and part[i].kind in ("word", "name") and part[i].upper not in RESERVED:
            alias, i = part[i].bare, i + 1
        found.append(Source(table, alias, how))
        how = ""
    return found


def _branch(sql: str, part: list[Token], nested: bool) -> Branch:
    clauses: dict[str, list[Token]] = {}
    now = ""
    i = 0
    while i < len(part):
        word = part[i].upper if part[i].kind == "word" else ""
        pair = f"{word} BY" if word in ("GROUP", "ORDER") and i + 1 < len(part) and part[i + 1].upper == "BY" else word
        if pair in CLAUSES:
            now = pair
            clauses[now] = []
            i += 2 if " " in pair else 1
            continue
        if now and part[i].text != ";":
            clauses[now].append(part[i])
        i += 1
    return Branch(clauses, _sources(sql, clauses.get("FROM", [])), nested)


def branches(sql: str) -> Iterator[Branch]:
    """All SELECTs of a text, outer ones before those inside them."""

    def walk(part: list[Token], nested: bool) -> Iterator[Branch]:
        cut, at = [], 0
        for i, t in enumerate(part):
            if t.kind == "word" and t.upper in SET_OPERATORS:
                cut.append(part[at:i])
                at = i + 1
        cut.append(part[at:])
        for piece in cut:
            start = next((i for i, t in enumerate(piece) if t.upper == "SELECT"), None)
            if start is not None:
                yield _branch(sql, piece[start:], nested)
        for t in part:
            if t.kind == "group":
                yield from walk(t.inside, True)

    yield from walk(tokens(sql), False)


def _calls(part: list[Token]) -> Iterator[tuple[Token, Token]]:
    """Functions with their arguments, outside subqueries."""
    for i, t in enumerate(part):
        if t.kind == "group" and not _is_query(t):
            if i and part[i - 1].kind == "word":
                yield part[i - 1], t
            yield from _calls(t.inside)


def _column_names(part: list[Token]) -> Iterator[tuple[str, str]]:
    """(qualifier or '', column) of each reference outside subqueries."""
    i = 0
    while i < len(part):
        t, after = part[i], part[i + 1] if i + 1 < len(part) else None
        before = part[i - 1] if i else None
        if t.kind == "group":
            if not _is_query(t):
                yield from _column_names(t.inside)
        elif t.kind in ("word", "name") and t.upper not in RESERVED:
            if after is not None and after.text == "." and i + 2 < len(part):
                if part[i + 2].text != "*":
                    yield t.bare, part[i + 2].bare
                i += 2
            elif not (after is not None and after.kind == "group" and t.kind == "word") and not (before is not None and (before.upper == "AS" or before.text == "::")):
                implicit = before is not None and (before.kind in ("number", "text", "group", "name") or before.kind == "word" and before.upper not in RESERVED or before.upper == "END")
                if not implicit:
                    yield "", t.bare
        i += 1


def _made_names(part: list[Token]) -> set[str]:
    """Names that a SELECT list gives to its columns."""
    return {part[i + 1].bare.lower() for i, t in enumerate(part[:-1]) if t.upper == "AS"}


def read(sql: str | None) -> dict:
    """The parts of a query: see components and column_refs."""
    sql = sql or ""
    found = list(branches(sql))
    tables: list[str] = []
    out: dict = {"tables": tables, "joins": [], "conditions": [], "aggregations": [], "ordering": [], "group_by": [], "having": [], "has_subquery": any(b.nested for b in found), "has_distinct": False}
    refs: dict[str, list[str]] = {}
    every = {s.table.lower(): s.table for b in found for s in b.sources if s.table} | {s.alias.lower(): s.table for b in found for s in b.sources if s.alias and s.table}
    for b in found:
        tables += [s.table for s in b.sources if s.table and s.table not in tables]
        out["joins"] += [{"type": s.join, "table": s.table, "on": s.on} for s in b.sources if s.join]
        for clause, key in (("WHERE", "conditions"), ("ORDER BY", "ordering"), ("GROUP BY", "group_by"), ("HAVING", "having")):
            if b.clauses.get(clause):
                out[key].append(_text(sql, b.clauses[clause]))
        out["has_distinct"] |= any(t.upper == "DISTINCT" for t in b.clauses.get("SELECT", []))
        for part in b.clauses.values():
            for name, group in _calls(part):
                call = " ".join(sql[name.start : group.end].split())
                if name.upper in AGGREGATES and call not in out["aggregations"]:
                    out["aggregations"].append(call)
                out["has_distinct"] |= bool(group.inside) and group.inside[0].upper == "DISTINCT"
        own = {s.alias.lower(): s.table for s in b.sources if s.alias} | {s.table.lower(): s.table for s in b.sources if s.table}
        made = _made_names(b.clauses.get("SELECT", []))
        for clause, part in b.clauses.items():
            if clause == "FROM":
                part = [t for s in _conditions(part) for t in s]
            for qualifier, column in _column_names(part):
                if qualifier:
                    table = own.get(qualifier.lower(), every.get(qualifier.lower()))
                elif clause in ("ORDER BY", "GROUP BY", "HAVING") and column.lower() in made:
                    table = None
                else:
                    table = next((s.table for s in b.sources if s.table), "")
                if table and column not in refs.setdefault(table, []):
                    refs[table].append(column)
    out["columns"] = [f"{t}.{c}".lower() for t in tables for c in refs.get(t, [])]
    return out


def _conditions(part: list[Token]) -> Iterator[list[Token]]:
    """The ON and USING parts of a FROM clause."""
    i = 0
    while i < len(part):
        if part[i].upper in ("ON", "USING"):
            end = i + 1
            while end < len(part) and part[end].text != "," and not _joins(part, end):
                end += 1
            yield part[i + 1 : end]
            i = end
        else:
            i += 1


_texts = ArrayType(StringType())
_join = StructType([StructField(n, StringType()) for n in ("type", "table", "on")])
PARTS = StructType(
    [StructField("tables", _texts), StructField("joins", ArrayType(_join))]
    + [StructField(n, _texts) for n in ("conditions", "aggregations", "ordering", "group_by", "having")]
    + [StructField("has_subquery", BooleanType()), StructField("has_distinct", BooleanType()), StructField("columns", _texts)]
)


@F.pandas_udf(PARTS)
def parts(sql: pd.Series) -> pd.DataFrame:
    rows = [read(s) for s in sql]
    return pd.DataFrame({n: [r[n] for r in rows] for n in PARTS.names})


def components(sql: Column) -> Column:
    """Struct of a query's parts, subqueries included, outer ones first: tables (distinct, in order), joins
    (type without OUTER, table, condition), conditions, aggregations (distinct calls), ordering, group_by and
    having as texts with single spaces, has_subquery, has_distinct, columns (table.column, lower-cased).

    A column without a qualifier belongs to the first table of its SELECT. Null and empty texts have no parts.
    """
    importable()
    return parts(sql)


# Replies of a model


LABELS = ("sql", "answer", "query", "result")


def _fenced(reply: str) -> Iterator[tuple[str, str]]:
    """(language, content) of each closed fence."""
    at = reply.find("```")
    while at >= 0:
        close = reply.find("```", at + 3)
        if close < 0:
            return
        inside = reply[at + 3 : close]
        head = re.match(r"sql\b|sqlite\b", inside, re.I)
        yield ("sql" if head and head.group().lower() == "sql" else "", inside[3:] if head and head.group().lower() == "sql" else inside)
        at = reply.find("```", close + 3)


def _labelled(reply: str) -> str | None:
    """A SELECT that follows a label and a colon, up to a blank line."""
    low = reply.lower()
    best = min(((p, label) for label in LABELS for p in _places(low, label)), default=None)
    if best is None:
        return None
    start = reply.index(":", best[0] + len(best[1])) + 1
    body = reply[start:].lstrip()
    return body.partition("\n\n")[0].strip()


def _places(low: str, label: str) -> Iterator[int]:
    at = low.find(label)
    while at >= 0:
        after = low[at + len(label) :].lstrip()
        if after.startswith(":"):
            body = after[1:].lstrip()
            if body.startswith("select") and not (body[6:7].isalnum() or body[6:7] == "_"):
                yield at
        at = low.find(label, at + 1)


def _statements(reply: str) -> Iterator[str]:
    """Texts from a SELECT to its semicolon or the end; a semicolon ends the search for further words within."""
    low, at = reply.lower(), 0
    while (at := low.find("select", at)) >= 0:
        follows = low[at + 6 : at + 7]
        if follows.isalnum() or follows == "_":
            at += 6
            continue
        end = reply.find(";", at)
        end = len(reply) if end < 0 else end + 1
        yield reply[at:end]
        at = end


def sql_in(reply: str | None) -> str:
    """The query that a reply gives; see extract_sql."""
    reply = reply or ""
    fences = list(_fenced(reply))
    for language, inside in fences:
        if language == "sql":
            return inside.strip()
    for _, inside in fences:
        if re.match(r"\s*select", inside, re.I):
            return inside.strip()
    if (labelled := _labelled(reply)) is not None:
        return labelled
    tag = reply.lower().find("[sql]")
    if tag >= 0:
        end = reply.lower().find("[/sql]", tag)
        return reply[tag + 5 : end if end >= 0 else len(reply)].strip()
    found = list(_statements(reply))
    if found:
        longest = sorted(found, key=len, reverse=True)[0].strip()
        return longest if longest.endswith(";") else f"{longest};"
    ended, mark, _ = reply.strip().rpartition(";")
    return ended + mark or reply.strip()


@F.pandas_udf(StringType())
def _extracted(reply: pd.Series) -> pd.Series:
    return reply.map(sql_in)


def extract_sql(reply: Column) -> Column:
    """The SQL in a reply: a sql fence, a fenced SELECT, a labelled SELECT up to a blank line, a [SQL] tag,
    the longest SELECT (ended by a semicolon), or else the text up to its last semicolon; null is empty."""
    importable()
    return _extracted(reply)
