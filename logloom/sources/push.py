"""Pushed lines as log lines: from files of JSON pushes, from tables of pushes, from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import jsonpath
from logloom.functions.text import index_terms, stop_words
from logloom.operators.ordered import join_keys, row_numbers
from logloom.schema import COLUMNS, LINE, PUSH


def read_pushes(spark: SparkSession, path: str) -> DataFrame:
    """Push bodies from JSON files; a malformed body or a body without a mandatory field fails the read."""
    df = spark.read.schema(PUSH).option("mode", "FAILFAST").json(path)
    lacks = F.col("source").isNull() | F.col("lines").isNull() | F.exists("lines", lambda x: x["ts"].isNull() | x["raw_data"].isNull() | x["structured"].isNull() | x["indexes"].isNull() | x["json_keys"].isNull())
    return df.where(F.when(lacks, F.raise_error(F.lit("a push lacks a mandatory field"))).otherwise(F.lit(True)))


def lines_of(pushes: DataFrame) -> DataFrame:
    """One row per pushed line with its place in the push; null lines are no lines."""
    own = [c for c in pushes.columns if c not in ("lines",)]
    x = pushes.select(*own, F.posexplode("lines").alias("place", "_l")).where("_l IS NOT NULL")
    return x.select(*own, "place", "_l.*")


def with_seq(lines: DataFrame, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """Add ``seq``: the ingestion order within a source, from 1, or from after the (source, seq)
    of ``last``. Rows equal in order are numbered in any order; a source of any size is numbered
    by ranges."""
    x = row_numbers(lines, ["source"], order, "seq")
    if last is not None:
        before = last.groupBy("source").agg(F.max("seq").alias("_last"))
        x = join_keys(x, before, ["source"]).withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")
    return x


def derived(lines: DataFrame, always: bool = False, stemmed: bool = True) -> DataFrame:
    """Index terms and JSON keys recomputed where they are null, or for every line."""
    stops = stop_words(lines.sparkSession)
    x = lines.withColumn("_flat", F.when(F.col("structured"), jsonpath.flatten(F.col("raw_data"))))
    terms = index_terms(F.col("raw_data"), F.col("structured"), F.col("_flat"), stops, stemmed)
    keys = F.coalesce(F.map_keys("_flat"), F.array().cast("array<string>"))
    pick = lambda name, new: new if always else F.coalesce(F.col(name), new)
    return x.withColumns({"indexes": pick("indexes", terms), "json_keys": pick("json_keys", keys)}).drop("_flat")


def checked(lines: DataFrame) -> DataFrame:
    """Log lines in column order; a line without source, ts, seq, structured or text fails the write."""
    missing: Column = F.lit(False)
    for c in ("source", "ts", "seq", "structured", "raw_data"):
        missing = missing | F.col(c).isNull()
    ok = F.when(missing, F.raise_error(F.lit("a log line lacks a mandatory field"))).otherwise(F.lit(True))
    return lines.select(*[F.col(c).cast(LINE[c].dataType).alias(c) for c in COLUMNS]).where(ok)
