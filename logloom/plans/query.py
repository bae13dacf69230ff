"""The piped query language: text to a flat, immutable ``Query``.

Blocks are joined by " | ". A block is tried as source, count, distinct, distinct_count, avg,
limit, distance, message and key selection in this order, and the first form whose text
matches is final: what follows must be " | " or the end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

DEFAULT_LIMIT = 10_000
DEFAULT_DISTANCE = 2

_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})'
_KEY = rf'(?:[^"\\) =]|{_ESCAPE})+'
_STRING = rf'"((?:[^"\\]|{_ESCAPE})*)"'
_NAME = r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*"
_ZS = "[\u0020\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]*"
_BLOCKS = [
    ("source", re.compile(rf"source{_ZS}={_ZS}({_NAME}(?:,{_NAME})*)")),
    ("count", re.compile(rf"count\(({_KEY})\) as ({_NAME})(?: by ({_KEY}))?")),
    ("distinct", re.compile(rf"distinct\(({_KEY})\)")),
    ("distinct_count", re.compile(rf"distinct_count\(({_KEY})\)")),
    ("avg", re.compile(rf"avg\(({_KEY})\) as ({_NAME})(?: by ({_KEY}))?")),
    ("limit", re.compile(r"limit ([0-9]+)")),
    ("distance", re.compile(r"distance ([0-9]+)")),
    ("message", re.compile(rf"message{_ZS}={_ZS}{_STRING}")),
    ("key", re.compile(rf"({_KEY}){_ZS}={_ZS}{_STRING}")),
]


class ParseError(ValueError):
    """The text is no query."""


@dataclass(frozen=True)
class Selection:
    """Lines with a term near ``value``; with ``key``, only lines that have this JSON key."""

    value: str
    key: str | None = None


@dataclass(frozen=True)
class Aggregate:
    """``kind`` is count, distinct, distinct_count or avg."""

    kind: str
    key: str
    alias: str | None = None
    by: str | None = None


@dataclass(frozen=True)
class Query:
    selection: Selection | None = None
    aggregate: Aggregate | None = None
    sources: tuple[str, ...] = ()
    limit: int = 0
    distance: int = 0


def _number(text: str, bits: int, what: str) -> int:
    n = int(text)
    if n >= 1 << bits:
        raise ParseError(f"{what} is too large: {text}")
    return n


def _add(q: Query, kind: str, m: re.Match) -> Query:
    if kind in ("count", "distinct", "distinct_count", "avg"):
        if q.aggregate:
            raise ParseError("Only one aggregation is supported. At least for now")
        alias, by = (m[2], m[3]) if kind in ("count", "avg") else (None, None)
        return replace(q, aggregate=Aggregate(kind, m[1], alias, by))
    if kind in ("message", "key"):
        if q.selection:
            raise ParseError("Only one selection statement exist")
        return replace(q, selection=Selection(m[1]) if kind == "message" else Selection(m[2], m[1]))
    if kind == "limit":
        if q.limit:
            raise ParseError("You can only use one limit operator")
        return replace(q, limit=_number(m[1], 64, "limit"))
    if kind == "distance":
        if q.distance:
            raise ParseError("Only one distance limit is allowed")
        return replace(q, distance=_number(m[1], 32, "distance"))
    if q.sources:
        raise ParseError("You can mention source only once")
    return replace(q, sources=tuple(m[1].split(",")))


def parse(text: str) -> Query:
    """The query of a text; "" is the query without any limit. Raises ``ParseError``."""
    if not text:
        return Query()
    q, at = Query(), 0
    while True:
        for kind, pattern in _BLOCKS:
            m = pattern.match(text, at)
            if m:
                break
        else:
            raise ParseError(f"no block at {at}: {text[at : at + 40]!r}")
        q, at = _add(q, kind, m), m.end()
        if at == len(text):
            break
        if not text.startswith(" | ", at):
            raise ParseError(f'expected " | " at {at}: {text[at : at + 40]!r}')
        at += 3
    if q.aggregate and q.limit:
        raise ParseError("Limit is not supported with aggregation. At least for now")
    return replace(q, limit=q.limit or DEFAULT_LIMIT, distance=q.distance or DEFAULT_DISTANCE)
