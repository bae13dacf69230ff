"""What a log shipper does before it pushes: parsers of program layouts, multi-line entries, routing.

Each parser takes a column of text and gives a struct of text fields; a line that doesn't fit
gives null.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import jsonpath
from logloom.functions.text import shipper_tokens, without_stop_words
from logloom.operators.ordered import running_max

# fixed values: the layouts of the programs
KLOG = r"(?s)^(\w)(\d{4} \S*)\s+(\d+)\s+([^ \]]+)\] (.*)"
SALT = r"^([^ ]* [^ ,]*)[^\[]*\[[^\]]*\]\[([^ \]]*) *\] (.*)$"
DOCKER = r'^time="([^)]*?)" level=([^ ]*) msg="([^"]*)"(?: err="([^"]*)")?(?: statusCode=\$?(\d+))?'
SYSLOG = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^\s:\[]*)(?:\[(\d+)\])?[^:]*: *(.*)$"
AUDIT = r"^(\S+) AUDIT:"
AUDIT_FIELDS = ["id", "ip", "method", "user", "groups", "as", "asgroups", "namespace", "uri", "response"]
KLOG_FIRST, AUDIT_FIRST = r"^\w\d{4}", r"^\S+\s+AUDIT:"


def _parts(text: Column, pattern: str, names: list[str]) -> Column:
    fields = [F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(text.rlike(pattern), F.struct(*fields))


def klog(text: Column) -> Column:
    """severity, time (MMDD HH:MM:SS.N), pid, source, message (further lines included)."""
    return _parts(text, KLOG, ["severity", "time", "pid", "source", "message"])


def salt(text: Column) -> Column:
    return _parts(text, SALT, ["time", "severity", "message"])


def docker(text: Column) -> Column:
    return _parts(text, DOCKER, ["time", "severity", "message", "error", "status_code"])


def syslog(text: Column) -> Column:
    return _parts(text, SYSLOG, ["pri", "time", "host", "ident", "pid", "message"])


def audit(text: Column) -> Column:
    """The time and the known key="value" pairs in any order; unknown keys are ignored, of a
    repeated key the last holds, absent keys are null."""

    def last(key: str) -> Column:
        all_of = F.regexp_extract_all(text, F.lit(rf'\s{key}="([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1))
        return F.try_element_at(all_of, F.lit(-1)).alias(key)

    return F.when(text.rlike(AUDIT), F.struct(F.regexp_extract(text, AUDIT, 1).alias("time"), *[last(k) for k in AUDIT_FIELDS]))


def container(text: Column) -> Column:
    """A container's JSON line: log, stream, and time as epoch seconds."""
    get = lambda k: F.get_json_object(text, f"$.{k}")
    seconds = F.floor(F.unix_millis(get("time").try_cast("timestamp")) / 1000)
    return F.when(F.try_parse_json(text).isNotNull(), F.struct(get("log").alias("log"), get("stream").alias("stream"), seconds.alias("ts")))


def journal(text: Column) -> Column:
    """A systemd journal entry in JSON export: unit, message, priority and epoch seconds."""
    get = lambda k: F.get_json_object(text, f"$.{k}")
    seconds = F.floor(get("__REALTIME_TIMESTAMP").try_cast("bigint") / 1_000_000)
    return F.when(F.try_parse_json(text).isNotNull(), F.struct(get("_SYSTEMD_UNIT").alias("unit"), get("MESSAGE").alias("message"), get("PRIORITY").alias("priority"), seconds.alias("ts")))


def multiline(lines: DataFrame, keys: list[str], order: str, text: str, first: str) -> DataFrame:
    """(keys, first, text): lines joined to records that each begin at a line matching ``first``.

    Lines before a key's first such line are dropped. A key's lines may lie in many tasks; only
    the lines of one record meet.
    """
    x = lines.select(*keys, order, text).withColumn("_start", F.when(F.col(text).rlike(first), F.col(order)))
    x = running_max(x, keys, [order], "_start", "first").where("first IS NOT NULL")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")
    return x.groupBy(*keys, "first").agg(joined.alias(text))


def forwarded(records: DataFrame, tag: str) -> DataFrame:
    """Records that are not the shipper's own: tags fluent.* go nowhere, null tags do."""
    return records.where(~F.coalesce(F.col(tag).startswith("fluent."), F.lit(False)))


def enriched(records: DataFrame, pods: DataFrame, on: str) -> DataFrame:
    """Records with what a table of pods knows of theirs; records of unknown pods stay."""
    return records.join(pods.dropDuplicates([on]), on, "left")


def routed(records: DataFrame, raw: str, ts: Column, stops: list[str]) -> DataFrame:
    """JSON records as log lines of the pod they name: text that is no object is dropped; terms
    come from strings and strings in arrays, keys from objects only."""
    v = jsonpath.body(F.col(raw))
    pod = F.get_json_object(raw, "$.kubernetes.pod_name")
    x = records.where(F.schema_of_variant(v).startswith("OBJECT") & pod.isNotNull())
    terms = without_stop_words(F.flatten(F.transform(_strings(F.col(raw)), shipper_tokens)), stops)
    return x.select(pod.alias("source"), ts.cast("bigint").alias("ts"), F.lit(True).alias("structured"), F.col(raw).alias("raw_data"), terms.alias("indexes"), jsonpath.object_keys(F.col(raw)).alias("json_keys"))


def _strings(raw: Column) -> Column:
    @F.pandas_udf("array<string>")
    def strings(s: pd.Series) -> pd.Series:
        def walk(d):
            for v in d.values():
                if isinstance(v, dict):
                    yield from walk(v)
                elif isinstance(v, str):
                    yield v
                elif isinstance(v, list):
                    yield from (x for x in v if isinstance(x, str))

        def one(t):
            try:
                v = json.loads(t) if isinstance(t, str) else None
                return list(walk(v)) if isinstance(v, dict) else []
            except (ValueError, RecursionError):
                return []

        return s.map(one)

    return strings(raw)
