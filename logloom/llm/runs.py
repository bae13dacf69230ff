"""Repeated consecutive events (problem 4), by boundary-only rows.

Every event is reduced to a key of what it says. Only events that differ from the one before
are kept; the lead over these starts gives the count of a run (difference of positions) and its
end (what the next start found before it). Rows are cut into ranges of (source, ts, seq) first,
so that a source of any size is spread over many tasks; runs over a range border are joined on
the border fragments alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordered import RANGE, Ranges, within
from logloom.runtime import cut

# fixed values: patterns of what changes with each emission
ANSI = r"(?:\x1b|\\u001b)\[[0-9;]*[a-z]"
# a run is entered at its first character only: long runs cost no more than their length
PROGRESS = r"(?<!\s)\s*+\[(?:(?=[=#>])[=#-]*+>?[ .-]*+| {5,})\]"
STAMPS = (
    r"\d{4}-\d\d-\d\d[t ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:z\b| ?[+-]\d\d:?\d\d\b)?"
    r"|\d\d/(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/\d{4}:\d\d:\d\d:\d\d(?: [+-]\d{4})?"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) +\d{1,2} \d\d:\d\d:\d\d"
)
KLOG = r"^([a-z])\d{4} \d\d:\d\d:\d\d\.\d+ +\d+ "
UUID = r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b"
IDS = r"\b(?:[a-z]{2,4}[-_])?(?=[a-f]*\d)[0-9a-f]{8,}\b"
ADDRESSES = r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b|\b(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}\b|\b0x[0-9a-f]+\b"
UNITS = "(?:ns|us|µs|ms|s|sec|secs|seconds|m|min|mins|minutes|h|hours)"
NUMBERS = rf"[+-]?\d+(?:,\d{{3}})*(?:\.\d+)?(?:e[+-]?\d+)?(?: ?{UNITS}(?:\d+(?:\.\d+)?{UNITS})*\b| ?%)?"
CLOSING = r"(?<![\s.!?…;,:])(?:\\[nrt]|[\s.!?…;,:])++(?=\"|$)"
AROUND = r"(?<!\s)\s++(?=[^\p{L}\p{N}\s])|(?<=[^\p{L}\p{N}\s])\s++"


def said(raw: Column) -> Column:
    """What a line says: JSON with its keys in order, without decoration, case, spacing, closing
    punctuation and progress, every changing value as ``#``. Null stays null."""
    text = F.trim(raw)
    looks = (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))
    # in an array of one, text after the value makes the whole invalid
    parsed = F.when(looks, F.to_json(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))))
    # a syslog head's priority holds the level: its digits become letters
    prio = F.regexp_extract(raw, r"^<(\d{1,3})>", 1)
    out = F.lower(F.coalesce(parsed, raw))
    out = F.regexp_replace(out, f"{ANSI}|{PROGRESS}", "")
    out = F.regexp_replace(out, KLOG, "$1 # # ")
    # one pass: at each place the first kind that fits
    out = F.regexp_replace(out, "|".join((STAMPS, UUID, IDS, ADDRESSES, NUMBERS)), "#")
    out = F.regexp_replace(out, CLOSING, "")
    out = F.regexp_replace(out, AROUND, "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(raw.isNotNull(), F.concat(F.translate(prio, "0123456789", "abcdefghij"), out))


def runs(df: DataFrame, max_gap: int = 600) -> DataFrame:
    """(source, first_ts, first_seq, last_ts, last_seq, n_lines, duration_s): every maximal run of
    neighbours in order of (ts, seq) that say the same, each at most ``max_gap`` seconds after the
    one before; a lone line is a run of one.

    Lines whose raw_data is null say the same as each other and as no text. Null sources are one
    source. Lines without ts come first and are runs of one each; null seq sorts first within ts.
    Rows equal in (source, ts, seq) stay separate lines. An empty table gives no rows; only
    source, ts, seq and raw_data are read.
    """
    what = F.coalesce(said(F.col("raw_data")), F.lit("\x00"))
    narrow = df.select(F.col("source"), F.col("ts").cast("bigint").alias("ts"), F.col("seq").cast("bigint").alias("seq"), what.alias("_s"))
    narrow = narrow.select("source", "ts", "seq", F.xxhash64("_s").alias("_a"), F.xxhash64(F.lit(1), "_s").alias("_b"))
    narrow = cut(narrow)
    rows = Ranges(narrow, ["source"], ["ts", "seq"]).over(narrow)
    w = within(["source"], ["ts", "seq", "_a", "_b"])
    one = F.struct("ts", "seq", "_a", "_b")
    rows = rows.withColumns({"_prev": F.lag(one).over(w), "_pos": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(RANGE, "source"))})
    rows = rows.withColumn("_tail", F.when(F.col("_pos") == F.col("_n"), F.struct("ts", "seq")))
    same = (F.col("_prev._a") == F.col("_a")) & (F.col("_prev._b") == F.col("_b")) & (F.col("ts") - F.col("_prev.ts") <= max_gap)
    # the starts, and each range's last row, which tells where its last run ends
    marks = rows.withColumn("_start", ~F.coalesce(same, F.lit(False))).where(F.col("_start") | F.col("_tail").isNotNull())
    w = within(["source"], ["_pos"])
    ahead = F.struct(F.col("_pos"), F.col("_start"), F.col("_prev"), F.col("_tail"))
    marks = marks.withColumn("_next", F.lead(ahead).over(w)).where("_start")
    stop = F.when(F.col("_next").isNull(), F.col("_pos")).when(F.col("_next._start"), F.col("_next._pos") - 1).otherwise(F.col("_next._pos"))
    last_ts = F.when(F.col("_next").isNull(), F.col("ts")).when(F.col("_next._start"), F.col("_next._prev.ts")).otherwise(F.col("_next._tail.ts"))
    last_seq = F.when(F.col("_next").isNull(), F.col("seq")).when(F.col("_next._start"), F.col("_next._prev.seq")).otherwise(F.col("_next._tail.seq"))
    parts = marks.select(
        "source", RANGE, "_pos", "_a", "_b", F.col("ts").alias("first_ts"), F.col("seq").alias("first_seq"), last_ts.alias("last_ts"), last_seq.alias("last_seq"),
        (stop - F.col("_pos") + 1).cast("bigint").alias("n_lines"), ((F.col("_pos") == 1) | (stop == F.col("_n"))).alias("_edge"),
    )
    cols = ["source", "first_ts", "first_seq", "last_ts", "last_seq", "n_lines"]
    # at most two fragments of a source in each range lie at a border
    edges = parts.where("_edge")
    w = Window.partitionBy("source").orderBy(RANGE, "_pos")
    before = F.lag(F.struct("_a", "_b", "last_ts")).over(w)
    edges = edges.withColumn("_before", before)
    goes_on = (F.col("_before._a") == F.col("_a")) & (F.col("_before._b") == F.col("_b")) & (F.col("first_ts") - F.col("_before.last_ts") <= max_gap)
    edges = edges.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    at = F.struct(RANGE, "_pos")
    joined = edges.groupBy("source", "_run").agg(
        F.min_by("first_ts", at).alias("first_ts"), F.min_by("first_seq", at).alias("first_seq"), F.max_by("last_ts", at).alias("last_ts"), F.max_by("last_seq", at).alias("last_seq"), F.sum("n_lines").alias("n_lines")
    )
    every = parts.where(~F.col("_edge")).select(*cols).unionByName(joined.select(*cols))
    return every.withColumn("duration_s", F.col("last_ts") - F.col("first_ts"))
