"""Results as the JSON envelope {"data": [...]}."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from logloom.plans.planner import Request, plan
from logloom.plans.query import Query, parse


def number(x: float) -> str:
    """Decimal text without a trailing .0."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _entry(text: str | None):
    """A JSON object or array as itself, other text as a string: the envelope is always valid."""
    try:
        v = json.loads(text or "", parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (ValueError, RecursionError):
        return text
    return v if isinstance(v, dict | list) else text


def pieces(df: DataFrame, query: str | Query) -> Iterator[str]:
    """The envelope of a query's result in pieces. Rows come partition by partition, so that a
    result of any length passes through; only one partition of it is in the driver at a time.

    Counts and averages are strings, frequencies numbers; a grouped aggregate without groups is
    one object of empty strings.
    """
    q = parse(query) if isinstance(query, str) else query
    a = q.aggregate

    def data(r):
        if a is None:
            return {"ts": r.ts, "entry": _entry(r.entry), "source": r.source}
        if a.kind == "distinct":
            return r[0]
        if a.kind == "distinct_count":
            return {r[0]: r[1]}
        text = lambda v: number(float(v)) if a.kind == "avg" else str(v)
        return {a.alias: text(r[0])} if a.by is None else {a.alias: text(r[1]), a.by: r[0]}

    n = 0
    yield '{"data": ['
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield (", " if n else "") + json.dumps(data(r), ensure_ascii=False)
        n += 1
    if not n and a is not None and a.by is not None:
        yield json.dumps({a.alias: "", a.by: ""}, ensure_ascii=False)
    yield "]}"


def render(df: DataFrame, query: str | Query) -> str:
    """The whole envelope as one text: for limited rows and groups."""
    return "".join(pieces(df, query))


def answer(logs: DataFrame, query: str, request: Request = Request()) -> str:  # noqa: B008
    return render(plan(logs, query, request), query)
