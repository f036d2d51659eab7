"""Boolean search queries compiled to column predicates.

``(cat:cs.RO OR cat:cs.AI) AND ("scene graph" OR memory) ANDNOT ti:survey``: fields cat, ti, abs,
au, all; quoted phrases; AND, OR, NOT, ANDNOT; parentheses; neighbours without a word are ANDed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(\(|\)|(?:[A-Za-z]+:)?"[^"]*"|[^\s()"]+)')


class QuerySyntaxError(ValueError):
    pass


def tokens(query: str) -> list[str]:
    out, at = [], 0
    text = query.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"cannot read {text[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


def term(token: str) -> Column:
    name, colon, value = token.partition(":")
    if not colon or name.startswith('"') or name.lower() not in ("cat", "ti", "abs", "au", "all"):
        name, value = "all", token
    value = value.strip('"').lower()
    if not value:
        raise QuerySyntaxError(f"nothing to look for in {token!r}")
    name = name.lower()
    if name == "cat":
        found = F.exists("categories", lambda c: F.lower(F.trim(c)) == value)
    elif name == "au":
        found = F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(value)))
    else:
        places = {"ti": ["title"], "abs": ["abstract"], "all": ["title", "abstract"]}[name]
        found = F.contains(F.lower(F.concat_ws(" ", *places)), F.lit(value))
    return F.coalesce(found, F.lit(False))


def compile_query(query: str) -> Column:
    """The predicate of a query; a query without a term matches everything."""
    ts = tokens(query)
    if not ts:
        return F.lit(True)
    out, at = _or(ts, 0)
    if at != len(ts):
        raise QuerySyntaxError(f"unexpected {ts[at]!r}")
    return out


def _or(ts: list[str], at: int) -> tuple[Column, int]:
    left, at = _and(ts, at)
    while at < len(ts) and ts[at].upper() == "OR":
        right, at = _and(ts, at + 1)
        left = left | right
    return left, at


def _and(ts: list[str], at: int) -> tuple[Column, int]:
    left, at = _not(ts, at)
    while at < len(ts) and ts[at] != ")" and ts[at].upper() != "OR":
        word = ts[at].upper()
        right, at = _not(ts, at + 1 if word in ("AND", "ANDNOT") else at)
        left = left & (~right if word == "ANDNOT" else right)
    return left, at


def _not(ts: list[str], at: int) -> tuple[Column, int]:
    if at >= len(ts):
        raise QuerySyntaxError("the query ends too early")
    if ts[at].upper() == "NOT":
        inner, at = _not(ts, at + 1)
        return ~inner, at
    if ts[at] == "(":
        inner, at = _or(ts, at + 1)
        if at >= len(ts) or ts[at] != ")":
            raise QuerySyntaxError("a parenthesis is not closed")
        return inner, at + 1
    if ts[at] == ")" or ts[at].upper() in ("AND", "OR", "ANDNOT"):
        raise QuerySyntaxError(f"unexpected {ts[at]!r}")
    return term(ts[at]), at + 1


def with_categories(query: str, categories: list[str], only_if_missing: bool = False) -> str:
    """A query restricted to any of some categories; unchanged without categories, and, if asked
    so, if it names one already."""
    if not categories or (only_if_missing and "cat:" in query):
        return query
    return f"({' OR '.join('cat:' + c for c in categories)}) AND ({query})"


def match_score(terms: list[str]) -> Column:
    """How often the terms occur, in the title three times as much."""
    out = F.lit(0)
    for t in terms:
        for place, weight in (("title", 3), ("abstract", 1)):
            text = F.lower(F.coalesce(F.col(place), F.lit("")))
            out = out + weight * ((F.length(text) - F.length(F.replace(text, F.lit(t.lower()), F.lit("")))) / len(t))
    return out.cast("int")
