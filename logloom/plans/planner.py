"""A query and a table of log lines to a DataFrame; nothing runs here."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import jsonpath
from logloom.plans.query import Query, Selection, parse


@dataclass(frozen=True)
class Request:
    """What comes with a query: the time range (0, 0 is everything), a row count that overrides the
    query's limit, an offset, the sources where the query names none, and the direction."""

    start_ts: int = 0
    end_ts: int = 0
    count: int = 0
    offset: int = 0
    partitions: tuple[str, ...] = ()
    forward: bool = False


def in_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Lines with start <= ts <= end. A table partitioned by event_date is pruned by day too."""
    if start == 0 and end == 0:
        return df
    df = df.where(F.col("ts").between(start, end))
    if "event_date" in df.columns:
        day = lambda t: F.date_from_unix_date(F.lit(max(min(t, 1 << 37), 0) // 86400).cast("int"))
        df = df.where(F.col("event_date").between(day(start), day(end)))
    return df


def near(value: str, distance: int) -> Column:
    """Some index term lies within the edit distance of the whole value; null terms lie nowhere."""
    hit = F.exists("indexes", lambda t: F.coalesce(F.levenshtein(t, F.lit(value), distance) >= 0, F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def holds(terms: Sequence[str]) -> Column:
    """Some index term is one of those listed."""
    listed = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.coalesce(F.arrays_overlap("indexes", listed), F.lit(False))


def selected(s: Selection, distance: int, terms: Sequence[str] | None = None) -> Column:
    """The lines a selection takes; ``terms`` are those near its value, where an index has told them."""
    hit = near(s.value, distance) if terms is None else holds(terms)
    return hit if s.key is None else F.coalesce(F.array_contains("json_keys", s.key), F.lit(False)) & hit


def scan(logs: DataFrame, q: Query, r: Request, terms: Sequence[str] | None = None) -> DataFrame:
    """The lines a query looks at: sources, time range and selection."""
    sources = q.sources or r.partitions
    if sources:
        logs = logs.where(F.col("source").isin(list(sources)))
    logs = in_range(logs, r.start_ts, r.end_ts)
    return logs.where(selected(q.selection, q.distance, terms)) if q.selection else logs


def rows(lines: DataFrame, q: Query, r: Request) -> DataFrame:
    """(ts, entry, source), newest first unless forward; ties go to the source named first (else by
    name), then to the later line (forward: the earlier)."""
    sources = q.sources or r.partitions
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")) if sources else F.col("source")
    order = ["ts", "_rank", "seq"] if r.forward else [F.desc("ts"), F.asc("_rank"), F.desc("seq")]
    out = lines.select("ts", F.col("raw_data").alias("entry"), "source", "seq", rank.alias("_rank")).orderBy(*order)
    if r.offset:
        out = out.offset(r.offset)
    limit = r.count or q.limit
    if limit:
        out = out.limit(min(limit, (1 << 31) - 1))
    return out.select("ts", "entry", "source")


def aggregated(lines: DataFrame, q: Query) -> DataFrame:
    """count and avg: the group column (named by its key), then the value under its alias.
    distinct: value. distinct_count: value, count. The group column of a value that is named like
    its alias ends in _key."""
    a = q.aggregate
    if a.kind != "count":
        lines = lines.where("structured")
    # the generator keeps filters on what the text holds from parsing it once more
    x = lines.select(F.explode(F.array(jsonpath.body(F.col("raw_data")))).alias("_b"))
    at = jsonpath.resolve(F.col("_b"), a.key)
    if a.kind in ("distinct", "distinct_count"):
        v = x.select(jsonpath.scalar_text(at).alias("value")).where("value IS NOT NULL")
        return v.distinct() if a.kind == "distinct" else v.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    value = F.when(at.isNotNull(), 1) if a.kind == "count" else jsonpath.numeric(at)
    agg = F.count if a.kind == "count" else F.avg
    if a.by is None:
        return x.select(value.alias("_v")).agg(F.coalesce(agg("_v"), F.lit(0)).alias(a.alias))
    by = a.by if a.by != a.alias else f"{a.by}_key"
    group = jsonpath.group_text(jsonpath.resolve(F.col("_b"), a.by))
    v = x.select(group.alias("_g"), value.alias("_v")).where("_v IS NOT NULL")
    return v.groupBy(F.col("_g").alias(by)).agg(agg("_v").alias(a.alias))


def plan(logs: DataFrame, query: str | Query, request: Request = Request(), terms: Sequence[str] | None = None) -> DataFrame:  # noqa: B008
    """The result of a query as a DataFrame: aggregates ignore limit, order and offset."""
    q = parse(query) if isinstance(query, str) else query
    lines = scan(logs, q, request, terms)
    return aggregated(lines, q) if q.aggregate else rows(lines, q, request)
