"""The store: log lines as Parquet, partitioned by source and day, with what is known about them beside.

A write makes a folder of its own, ``batch=<id>``; written again under the same id it replaces
itself. Beside the lines it leaves three small tables of the same batch: ``_files`` (the time
bounds of every file), ``_terms`` (the distinct index terms of every source and day) and ``_seq``
(the last number of every source). Queries skip files by the first, compare a searched term with
distinct terms instead of lines by the second; numbering goes on from the third.
"""

from __future__ import annotations

import datetime
import threading
import traceback
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.plans.planner import Request, plan
from logloom.plans.query import parse
from logloom.runtime import cut
from logloom.schema import COLUMNS, LINE
from logloom.sources.push import checked, derived, with_seq

#: Lines of a segment.
SEGMENT = 400
#: Files, and terms, that a query names one by one; where there are more it reads by statistics, or
#: compares terms line by line, with the same result.
NAMED = 4096
STORED = T.StructType([*LINE.fields, T.StructField("event_date", T.DateType())])
SIDE = {
    "_files": "file string, source string, event_date date, start_ts bigint, end_ts bigint, n_lines bigint, batch string",
    "_terms": "size int, term string, source string, event_date date, n_lines bigint, batch string",
    "_seq": "source string, last_seq bigint, batch string",
}


def day_of(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts / 86400).cast("int"))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write(lines: DataFrame, path: str, batch: str | None = None) -> None:
    """Append log lines. Rows of a source and day are clustered by ts, so that a file's statistics
    prune time ranges; large sources are spread over several writers by range."""
    spark, batch = lines.sparkSession, batch or uuid.uuid4().hex
    x = checked(lines).withColumn("event_date", day_of(F.col("ts")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(n, "source", "event_date", "ts").sortWithinPartitions("source", "event_date", "ts", "seq")
    own = f"{path}/batch={batch}"
    x.write.mode("overwrite").partitionBy("source", "event_date").parquet(own)
    new = spark.read.schema(STORED).parquet(own)
    files = new.groupBy(F.col("_metadata.file_path").alias("file"), "source", "event_date").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_lines"))
    terms = new.select("source", "event_date", F.explode(F.array_distinct("indexes")).alias("term")).where("term IS NOT NULL")
    terms = terms.groupBy(F.length("term").alias("size"), "term", "source", "event_date").agg(F.count(F.lit(1)).alias("n_lines"))
    seqs = new.groupBy("source").agg(F.max("seq").alias("last_seq"))
    for name, t in (("_files", files), ("_terms", terms.repartitionByRange("size", "term").sortWithinPartitions("size", "term")), ("_seq", seqs)):
        t.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def side(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables beside the lines; empty for a store that nothing was written to."""
    fs, at = _fs(spark, f"{path}/{name}")
    return spark.read.schema(SIDE[name]).parquet(f"{path}/{name}") if fs.exists(at) else spark.createDataFrame([], SIDE[name])


def read(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The stored lines with event_date, by which time ranges prune directories. Source names stay text."""
    reader = spark.read.schema(STORED)
    if files is not None and not files:
        return spark.createDataFrame([], STORED).select(*COLUMNS, "event_date")
    return (reader.parquet(path) if files is None else reader.option("basePath", path).parquet(*files)).select(*COLUMNS, "event_date")


def files_of(spark: SparkSession, path: str, start: int, end: int, sources: tuple[str, ...] = ()) -> list[str] | None:
    """The files that hold lines of a time range, by true overlap of their bounds, and of sources
    if given; None if the range doesn't restrict them, or leaves too many to name."""
    if start == 0 and end == 0:
        return None
    known = side(spark, path, "_files").where((F.col("start_ts") <= end) & (F.col("end_ts") >= start))
    known = known.where(F.col("source").isin(list(sources))) if sources else known
    got = [r.file for r in known.select("file").limit(NAMED + 1).collect()]
    return got if len(got) <= NAMED else None


def near_terms(spark: SparkSession, path: str, value: str, distance: int) -> DataFrame:
    """(term, source, event_date) of the stored terms within the distance: every distinct term is
    compared once, and by its length first."""
    t = side(spark, path, "_terms").where(F.col("size").between(len(value) - distance, len(value) + distance))
    one = t.select("term").distinct().where(F.levenshtein("term", F.lit(value), distance) >= 0)
    return t.join(one, "term", "left_semi").select("term", "source", "event_date")


def search(spark: SparkSession, path: str, text: str, request: Request = Request()) -> DataFrame:  # noqa: B008
    """The result of a query on the store: what ``plan`` gives, by way of the tables beside the lines."""
    q = parse(text)
    logs = read(spark, path, files_of(spark, path, request.start_ts, request.end_ts, q.sources or request.partitions))
    if q.selection is None:
        return plan(logs, q, request)
    hits = cut(near_terms(spark, path, q.selection.value, q.distance))
    terms = [r.term for r in hits.select("term").distinct().limit(NAMED + 1).collect()]
    if len(terms) > NAMED:
        return plan(logs, q, request)
    # directories without such a term are skipped as the join is run
    days = hits.select(F.col("source").alias("_s"), F.col("event_date").alias("_d")).distinct()
    logs = logs.join(days, (F.col("source") == F.col("_s")) & (F.col("event_date") == F.col("_d")), "left_semi")
    return plan(logs, q, request, terms)


def last_seqs(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """(source, seq): the last number of every source, of all batches but one."""
    t = side(spark, path, "_seq")
    t = t if but is None else t.where(F.col("batch") != but)
    return t.groupBy("source").agg(F.max("last_seq").alias("seq"))


def ingest(lines: DataFrame, path: str, order: list[str], index: bool = True, batch: str | None = None) -> None:
    """Number, index and append new lines; numbering goes on after what the store holds, of which
    only the last numbers are read."""
    x = with_seq(lines, order, last_seqs(lines.sparkSession, path, batch))
    write(derived(x) if index else x, path, batch)


def compact(spark: SparkSession, path: str) -> None:
    """All batches as one, in few large files. Nothing may read or write the store meanwhile."""
    fs, root = _fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    write(read(spark, path), path)
    for p in old:
        for at in (p, *(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{p.getName()}") for name in SIDE)):
            fs.delete(at, True)


def sources(logs: DataFrame) -> DataFrame:
    """The catalog of sources."""
    return logs.select("source").where("source IS NOT NULL").distinct()


def segments(logs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The registry: per source its segments of ``size`` lines by seq with their bounds; end_ts is
    the ts of the last line, not the greatest."""
    seg = (F.floor((F.col("seq") - 1) / size) + 1).cast("bigint")
    return logs.groupBy("source", seg.alias("segment_id")).agg(
        F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("end_ts"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n_lines")
    )


def overlapping(registry: DataFrame, start: int, end: int) -> DataFrame:
    """The segments of a registry that may hold lines of a time range: true overlap of intervals."""
    return registry.where((F.least("start_ts", "end_ts") <= end) & (F.greatest("start_ts", "end_ts") >= start))


def expired(registry: DataFrame, now: int, period: int | Column) -> DataFrame:
    """Segments whose end lies more than ``period`` seconds before ``now``; a null period keeps all."""
    p = F.lit(period) if isinstance(period, int) else period
    return registry.where(F.lit(now) - F.col("end_ts") > p)


def retain(logs: DataFrame, now: int, period: int, size: int = SEGMENT) -> DataFrame:
    """The lines of all segments that haven't expired; segments that end in the future stay."""
    gone = expired(segments(logs, size), now, period).select(F.col("source").alias("_s"), F.col("segment_id").alias("_g"))
    seg = (F.floor((F.col("seq") - 1) / size) + 1).cast("bigint")
    return logs.join(gone, F.col("source").eqNullSafe(F.col("_s")) & (seg == F.col("_g")), "left_anti")


def drop_days(spark: SparkSession, path: str, now: int, period: int) -> list[str]:
    """Delete the directories of days that lie wholly before now - period; their names."""
    fs, _ = _fs(spark, path)
    gone = []
    for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/source=*/event_date=*")) or []:
        p = s.getPath()
        day = p.getName().split("=", 1)[1]
        if day[:1].isdigit() and now - ((datetime.date.fromisoformat(day) - datetime.date(1970, 1, 1)).days + 1) * 86400 + 1 > period:
            fs.delete(p, True)
            gone.append(f"{p.getParent().getName()}/{p.getName()}")
    if gone:
        # bounds and terms of files that are gone would name what can't be read
        limit = F.date_add(F.lit(datetime.date(1970, 1, 1)), (now - period + 86399) // 86400 - 1)
        for name in ("_files", "_terms"):
            kept = cut(side(spark, path, name).where((F.col("event_date") >= limit)))
            kept.write.mode("overwrite").partitionBy("batch").parquet(f"{path}/{name}")
    return sorted(set(gone))


def every(seconds: float, job, stop: threading.Event) -> threading.Thread:
    """Runs ``job()`` now and then every so many seconds until ``stop`` is set; a failed run is
    reported, and the next one comes all the same."""

    def loop() -> None:
        while not stop.is_set():
            try:
                job()
            except Exception:  # noqa: BLE001
                traceback.print_exc()
            stop.wait(seconds)

    t = threading.Thread(target=loop, daemon=True)
    t.start()
    return t


def reindex(logs: DataFrame, stemmed: bool = True) -> DataFrame:
    """The lines with index terms and JSON keys computed anew from their text."""
    return derived(logs, always=True, stemmed=stemmed)


def reindex_missing(spark: SparkSession, path: str) -> list[str]:
    """Give every batch that lacks a table beside its lines these tables, and its lines without
    terms or keys these: what a write that broke off left behind. The batches' names."""
    fs, root = _fs(spark, path)
    todo = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("batch=") and not all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{t}/{name}/_SUCCESS")) for t in SIDE):
            todo.append(name)
    for name in todo:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            write(derived(cut(spark.read.schema(STORED).parquet(f"{path}/{name}").select(*COLUMNS))), path, name.split("=", 1)[1])
        else:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)  # never committed
    return todo
