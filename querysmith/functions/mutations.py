"""Mutations that need to know a query's clauses: they edit the text at the places of its tokens, and leave the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import importable
from .sql_parse import Branch, Token, branches, tokens

#: The longest name that counts as an alias.
ALIAS = 4


def _clause(sql: str, name: str) -> list[Token]:
    """The clause of the first SELECT, outer ones before inner ones, that has it."""
    return next((b.clauses[name] for b in branches(sql) if b.clauses.get(name)), [])


def _split(part: list[Token], sign: str) -> list[list[Token]]:
    terms: list[list[Token]] = [[]]
    for t in part:
        if t.text == sign:
            terms.append([])
        else:
            terms[-1].append(t)
    return [t for t in terms if t]


def turned_order(sql: str | None) -> str | None:
    """A term of ORDER BY the other way round: the first that says ASC, else the first that says DESC, else the first."""
    terms = _split(_clause(sql or "", "ORDER BY"), ",")
    if not terms:
        return None
    for old, new in (("ASC", "DESC"), ("DESC", "ASC")):
        said = [t for term in terms for t in term if t.kind == "word" and t.upper == old]
        if said:
            return sql[: said[0].start] + new + sql[said[0].end :]
    first = next((t for t in terms[0] if t.kind == "word" and t.upper == "NULLS"), None)
    at = terms[0][-1].end if first is None else terms[0][terms[0].index(first) - 1].end
    return f"{sql[:at]} DESC{sql[at:]}"


def _terms(part: list[Token]) -> list[list[Token]]:
    """The terms of a condition, cut at each AND that doesn't belong to a BETWEEN."""
    terms: list[list[Token]] = [[]]
    between = False
    for t in part:
        word = t.upper if t.kind == "word" else ""
        if word == "AND" and not between:
            terms.append([])
            continue
        between = word == "BETWEEN" or between and word != "AND"
        terms[-1].append(t)
    return terms


def less_conditions(sql: str | None) -> str | None:
    """Without the last term of WHERE, or without WHERE where it has one term."""
    part = _clause(sql or "", "WHERE")
    terms = _terms(part)
    if not part or not all(terms):
        return None
    if len(terms) > 1:
        return sql[: terms[-2][-1].end] + sql[terms[-1][-1].end :]
    head = sql[: part[0].start].rstrip()
    return head[: -len("WHERE")].rstrip() + sql[part[-1].end :]


def _qualifiers(part: list[Token]) -> list[Token]:
    """Names before a dot, at any depth."""
    found = []
    for i, t in enumerate(part):
        if t.kind == "group":
            found += _qualifiers(t.inside)
        elif t.kind in ("word", "name") and i + 1 < len(part) and part[i + 1].text == "." and not (i and part[i - 1].text == "."):
            found.append(t)
    return found


def other_aliases(sql: str | None) -> str | None:
    """The short aliases of the first two tables that have one exchanged where they qualify columns."""
    sql = sql or ""
    found: list[Branch] = list(branches(sql))
    aliases = list(dict.fromkeys(s.alias for b in found for s in b.sources if s.table and s.alias and len(s.alias) <= ALIAS))[:2]
    if len(aliases) < 2:
        return None
    swap = dict(zip(aliases, reversed(aliases), strict=True))
    out, at = [], 0
    for t in _qualifiers(tokens(sql)):
        if t.text in swap:
            out += [sql[at : t.start], swap[t.text]]
            at = t.end
    return "".join([*out, sql[at:]]) if out else None


def of(sql: Column, f) -> Column:
    """A mutation over a column of texts; null where it doesn't apply. Equal texts of a batch are read once."""
    importable()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        made = {x: f(x) for x in texts.unique() if x is not None}
        return texts.map(lambda x: None if x is None else made[x])

    return run(sql)
