"""Boolean trigram queries for regular expressions.

A query is an OR of ANDs: a list of sets of trigrams. A text can match the expression only if it holds
all trigrams of one set, upper and lower case folded. ``None`` means that no trigram is mandatory.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

Query = list[frozenset[str]] | None
MOST_STRINGS, MOST_CLAUSES = 32, 64


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _of_strings(strings: set[str]) -> Query:
    return None if any(len(s) < 3 for s in strings) else _least([trigrams(s) for s in strings])


def _least(clauses: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without clauses that another one implies."""
    own = set(clauses)
    return sorted((c for c in own if not any(o < c for o in own)), key=sorted)


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = _least([x | y for x in a for y in b])
    return both if len(both) <= MOST_CLAUSES else min(a, b, key=len)


def _or(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else _least([c for q in queries for c in q or []])


def _analyse(items) -> tuple[set[str] | None, Query]:
    """All strings that the items can match, if those are few, and else what any match must hold."""
    now: set[str] = {""}
    query, exact = None, True
    for kind, arg in items:
        if kind is op.AT:
            continue
        strings, inner = _item(kind, arg)
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        query, exact = _and(query, _of_strings(now)), False
        if strings is not None:
            now = strings
        else:
            query, now = _and(query, inner), {""}
    return (now, _of_strings(now)) if exact else (None, _and(query, _of_strings(now)))


def _item(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(arg).lower()}, None
    if kind is op.IN:
        few: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                few.add(chr(a).lower())
            elif k is op.RANGE and a[1] - a[0] < 8:
                few |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, None
        return (few, None) if len(few) <= 8 else (None, None)
    if kind is op.SUBPATTERN:
        return _analyse(arg[3])
    if kind is op.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), None
        return None, _or([q if s is None else _of_strings(s) for s, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, sub = arg
        strings, inner = _analyse(sub)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == 0:
            return None, None
        if strings is not None and len(strings) ** min(low, 9) <= MOST_STRINGS:
            some = {""}
            for _ in range(min(low, 9)):
                some = {a + b for a in some for b in strings}
            return (some, None) if low == high <= 9 else (None, _of_strings(some))
        return None, inner
    return None, None


def query(pattern: str) -> Query:
    """The trigram query of a regular expression, or None where none is mandatory."""
    strings, found = _analyse(parser.parse(pattern))
    return found if strings is None else _of_strings(strings)
