"""Other tables seen as log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.schema import COLUMNS


def events_as_logs(events: DataFrame) -> DataFrame:
    """One structured line per event, its source being the event type; props become an object."""
    props = F.from_json("props", "struct<k:bigint>")
    raw = F.to_json(F.struct("event_id", "user_id", "event_type", "value", props.alias("props")))
    keys = [F.lit(k) for k in ("event_id", "user_id", "event_type", "value", "props.k")]
    return events.select(
        F.col("event_type").alias("source"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("ts"), F.col("event_id").cast("bigint").alias("seq"), F.lit(True).alias("structured"),
        raw.alias("raw_data"), F.array("event_type").alias("indexes"), F.array(*keys).alias("json_keys"),
    ).select(*COLUMNS)


def documents_as_logs(docs: DataFrame) -> DataFrame:
    """One text line per document; terms are its tokens at single spaces."""
    return docs.select(
        "source", F.col("doc_id").alias("ts"), F.col("doc_id").alias("seq"), F.lit(False).alias("structured"), F.col("text").alias("raw_data"), F.split("text", " ").alias("indexes"), F.array().cast("array<string>").alias("json_keys")
    ).select(*COLUMNS)


def tail_as_logs(tail: DataFrame) -> DataFrame:
    return tail.select(F.col("app").alias("source"), "ts", F.col("line_no").alias("seq"), "structured", F.col("inner").alias("raw_data"), F.lit(None).cast("array<string>").alias("indexes"), F.lit(None).cast("array<string>").alias("json_keys"))


def lineitems_as_logs(items: DataFrame) -> DataFrame:
    """One text line per order item, of the source of its return flag, at its shipping date."""
    text = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return items.select(
        F.col("l_returnflag").alias("source"), F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000).cast("bigint").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq"),
        F.lit(False).alias("structured"), text.alias("raw_data"), F.array("l_returnflag").alias("indexes"), F.array().cast("array<string>").alias("json_keys"),
    ).select(*COLUMNS)
