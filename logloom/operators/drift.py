"""Schemas that drift between files (problem 6).

Every file (a push) is loaded as path-value maps with raw types; statistics per (file, path) are
aggregated in a distributed way; each file is compared with its source's file before; and all
rows can be projected to one table of typed columns, failed casts reported.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.nested import parse
from logloom.operators.ordered import previous
from logloom.runtime import column_names, cut

#: Changed fields per bucket that are paired at a time, about.
PAIRED = 5_000
ID = re.compile(r"^([A-Za-z]+[-_])[0-9A-Fa-f-]*\d[0-9A-Fa-f-]*$")


def flatten(value: dict) -> Iterator[tuple[str, object]]:
    """Dotted paths through objects; arrays are leaves; nulls and empty objects have no field."""
    todo = [("", value)]
    while todo:
        pre, d = todo.pop()
        for k, v in d.items():
            if isinstance(v, dict):
                todo.append((f"{pre}{k}.", v))
            elif v is not None:
                yield f"{pre}{k}", v


def kind_of(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return "array" if isinstance(v, list) else "string"


def _values(v) -> Iterator[tuple[str | None, float | None]]:
    """(word or id prefix, number) of a value; of an array, of each of its scalars."""
    for x in v if isinstance(v, list) else [v]:
        if isinstance(x, bool):
            yield str(x).lower(), None
        elif isinstance(x, int | float):
            try:
                yield None, float(x)
            except OverflowError:
                yield None, float("inf") if x > 0 else float("-inf")
        elif isinstance(x, str):
            m = ID.match(x)
            if m:
                yield f"{m[1]}#", None
            else:
                try:
                    yield None, float(x)
                except ValueError:
                    yield x, None


STATS = "source string, push_id string, path string, kind string, n bigint, ints bigint, least double, most double"
#: Columns of the typed table, at most; beyond that ``path_maps`` gives rows of path and value.
COLUMNS = 4000
#: (push, path, kind, word) rows that are made distinct at a time in Python.
WORDS = 50_000


def _load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        acc: dict[tuple, list] = {}
        for source, push, text in zip(pdf["source"], pdf["push_id"], pdf["raw_data"], strict=True):
            try:
                value = parse(text)
            except ValueError:
                continue
            if not isinstance(value, dict):
                continue
            for path, v in flatten(value):
                a = acc.setdefault((source, push, path, kind_of(v)), [0, 0, None, None])
                a[0] += 1
                a[1] += type(v) is int and -(1 << 63) <= v < 1 << 63
                for _, number in _values(v):
                    if number is not None and number == number:
                        a[2] = number if a[2] is None else min(a[2], number)
                        a[3] = number if a[3] is None else max(a[3], number)
        yield pd.DataFrame([(*k, *a) for k, a in acc.items()], columns=["source", "push_id", "path", "kind", "n", "ints", "least", "most"])


def _load_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["source", "push_id", "path", "kind", "word"]
    for pdf in parts:
        seen: set[tuple] = set()
        for source, push, text, paths in zip(pdf["source"], pdf["push_id"], pdf["raw_data"], pdf["paths"], strict=True):
            try:
                value = parse(text)
            except ValueError:
                continue
            if not isinstance(value, dict):
                continue
            wanted = set(paths)
            for path, v in flatten(value):
                if path in wanted:
                    seen.update((source, push, path, kind_of(v), word) for word, _ in _values(v) if word is not None)
            if len(seen) >= WORDS:
                yield pd.DataFrame(list(seen), columns=names)
                seen = set()
        if seen:
            yield pd.DataFrame(list(seen), columns=names)


def push_lines(pushes: DataFrame) -> DataFrame:
    """(source, push_id, ts, raw_data) of the lines of every push; null lines are no lines."""
    x = pushes.select("source", "push_id", F.explode("lines").alias("_l")).where("_l IS NOT NULL")
    return x.select("source", "push_id", F.col("_l.ts").alias("ts"), F.col("_l.raw_data").alias("raw_data"))


def path_stats(pushes: DataFrame) -> DataFrame:
    """(source, push_id, path, kind, n, ints, least, most): per file and path, how many values of which
    type there are, how many of them are 64-bit integers, and their range of numbers."""
    # ids pass through pandas as text, which keeps nulls and large numbers
    lines = push_lines(pushes).select("source", F.col("push_id").cast("string").alias("push_id"), "raw_data")
    parts = lines.mapInPandas(_load, STATS).withColumn("push_id", F.col("push_id").cast("bigint"))
    return parts.groupBy("source", "push_id", "path", "kind").agg(F.sum("n").alias("n"), F.sum("ints").alias("ints"), F.min("least").alias("least"), F.max("most").alias("most"))


def path_words(pushes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_s, push_id, path, kind, word): the distinct words and id prefixes, all of them, of the
    fields that ``wanted`` (_s, push_id, path) names; other pushes and fields are left out."""
    paths = wanted.groupBy("_s", "push_id").agg(F.collect_set("path").alias("paths"))
    lines = push_lines(pushes).withColumn("_s", F.coalesce("source", F.lit("\x00"))).join(paths, ["_s", "push_id"])
    rows = lines.select(F.col("_s").alias("source"), F.col("push_id").cast("string").alias("push_id"), "raw_data", "paths")
    found = rows.mapInPandas(_load_words, "source string, push_id string, path string, kind string, word string")
    return found.select(F.col("source").alias("_s"), F.col("push_id").cast("bigint").alias("push_id"), "path", "kind", "word").distinct()


def file_fields(pushes: DataFrame) -> DataFrame:
    """One row per (source, push_id, path): the type most of its values have, with their range of numbers.

    Of equally frequent types the first by name holds.
    """
    s = path_stats(pushes)
    best = F.struct(-F.col("n"), F.col("kind"))
    return s.groupBy("source", "push_id", "path").agg(*[F.min_by(c, best).alias(c) for c in ("kind", "least", "most")])


def alike(kind: str, a, b, shared: int) -> float:
    """How far two fields of one type hold the same kind of values, 0 to 1; ``n_words`` of each
    and ``shared`` count distinct words."""
    wa, wb = a["n_words"], b["n_words"]
    if kind == "boolean":
        return 1.0
    if wa or wb:
        return shared / min(wa, wb) if wa and wb else 0.0
    if pd.isna(a["least"]) or pd.isna(b["least"]):
        return 0.0
    lo, hi = max(a["least"], b["least"]), min(a["most"], b["most"])
    if hi < lo:
        # ranges of few values may lie side by side: near ones still count, a little
        gap, scale = lo - hi, max(abs(lo), abs(hi), 1e-9)
        return 0.5 if gap <= 0.25 * scale else 0.0
    span = max(a["most"], b["most"]) - min(a["least"], b["least"])
    return 1.0 if span == 0 else 0.6 + 0.4 * (hi - lo) / span


def _words_of(path: str) -> set[str]:
    return set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", path.rpartition(".")[2]).lower()))


CHANGES = "source string, push_id bigint, change_kind string, field_before string, field_after string"


def _pair(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The rows of some pushes, each with its fields gone and new of one type, best fits first."""
    out = []
    common = {(s, p, x, y): n for s, p, x, y, n in zip(*[pairs[c] for c in ("_s", "push_id", "before", "after", "shared")], strict=True)}
    for _, own in pdf.groupby(["_s", "push_id", "kind"], sort=False):
        gone, new = own[own["side"] == "removed"].to_dict("records"), own[own["side"] == "added"].to_dict("records")
        fits = []
        for i, x in enumerate(gone):
            for j, y in enumerate(new):
                if (score := alike(x["kind"], x, y, common.get((x["_s"], x["push_id"], x["path"], y["path"]), 0))) >= 0.5:
                    name = len(_words_of(x["path"]) & _words_of(y["path"])) > 0
                    fits.append((-(score + name), x["path"], y["path"], i, j))
        used_i, used_j = set(), set()
        head = ((gone or new)[0]["source"], (gone or new)[0]["push_id"])
        for _, before, after, i, j in sorted(fits):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                out.append((*head, "renamed", before, after))
        out += [(*head, "removed", x["path"], "") for i, x in enumerate(gone) if i not in used_i]
        out += [(*head, "added", "", y["path"]) for j, y in enumerate(new) if j not in used_j]
    return pd.DataFrame(out, columns=["source", "push_id", "change_kind", "field_before", "field_after"])


def changes(pushes: DataFrame) -> DataFrame:
    """Every change of fields, as (source, push_id, change_kind, field_before, field_after).

    Non-empty pushes of a source are ordered by (least ts of their lines, push_id), each compared
    with the one before; a source's first push has no changes. A push all of whose ts are null
    comes first. A push without valid JSON objects has no fields. Null sources are one source;
    pushes without push_id are left out, as nothing could name them.
    """
    lines = push_lines(pushes.where("push_id IS NOT NULL"))
    files = lines.groupBy("source", "push_id").agg(F.min("ts").alias("first_ts"))
    order = previous(files, ["source"], ["first_ts", "push_id"], ["push_id"]).where("has_prev").select(
        F.coalesce("source", F.lit("\x00")).alias("_s"), F.col("push_id").alias("_now"), F.col("prev_push_id").alias("_before")
    )
    f = file_fields(pushes).where("push_id IS NOT NULL").withColumn("_s", F.coalesce("source", F.lit("\x00")))
    own = [F.struct("kind", "least", "most").alias("_x")]
    now = f.join(order.select("_s", F.col("_now").alias("push_id")), ["_s", "push_id"]).select("_s", "push_id", "path", *own)
    then = f.withColumnRenamed("push_id", "_before").join(order, ["_s", "_before"]).select("_s", F.col("_now").alias("push_id"), "path", *own)
    both = now.withColumnRenamed("_x", "_new").join(then.withColumnRenamed("_x", "_old"), ["_s", "push_id", "path"], "full")
    source = F.when(F.col("_s") != "\x00", F.col("_s"))
    same = F.col("_new").isNotNull() & F.col("_old").isNotNull()
    both = cut(both.where(~same | (F.col("_new.kind") != F.col("_old.kind"))))
    retyped = both.where(same).select(source.alias("source"), "push_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("field_before"), F.col("path").alias("field_after"))
    side = F.when(F.col("_new").isNotNull(), "added").otherwise("removed")
    x = F.coalesce("_new", "_old")
    single = both.where(~same).select("_s", source.alias("source"), "push_id", "path", side.alias("side"), x["kind"].alias("kind"), x["least"].alias("least"), x["most"].alias("most"))
    # only where a push both loses and gains fields of one type is there anything to pair
    per = Window.partitionBy("_s", "push_id", "kind")
    single = single.withColumn("_both", F.size(F.collect_set("side").over(per)) == 2)
    plain = single.where("NOT _both").select(
        "source", "push_id", F.col("side").alias("change_kind"), F.when(F.col("side") == "removed", F.col("path")).otherwise("").alias("field_before"), F.when(F.col("side") == "added", F.col("path")).otherwise("").alias("field_after")
    )
    # words are counted exactly, of these pushes' fields only: a push's new ones and those gone from the push before
    fields = single.where("_both AND kind IN ('string', 'array')").select("_s", "push_id", "path", "kind", "side")
    gone = fields.where("side = 'removed'").join(order.select("_s", F.col("_now").alias("push_id"), "_before"), ["_s", "push_id"])
    at = fields.where("side = 'added'").withColumn("_at", F.col("push_id")).unionByName(gone.withColumnRenamed("_before", "_at"))
    at = cut(at)
    words = path_words(pushes, at.select("_s", F.col("_at").alias("push_id"), "path")).withColumnRenamed("push_id", "_at")
    words = cut(words.join(at, ["_s", "_at", "path", "kind"]).select("_s", "push_id", "kind", "side", "path", "word"))
    n_words = words.groupBy("_s", "push_id", "kind", "side", "path").agg(F.count(F.lit(1)).alias("n_words"))
    key = ["_s", "push_id", "kind", "word"]
    before, after = [words.where(F.col("side") == x).select(*key, F.col("path").alias(name)) for x, name in (("removed", "before"), ("added", "after"))]
    shared = before.join(after, key).groupBy("_s", "push_id", "before", "after").agg(F.count(F.lit(1)).alias("shared"))
    # a bucket of pushes at a time; what one push gains and loses is as much as its schema has, at most
    n = both.count()
    bucket = F.pmod(F.xxhash64("_s", "push_id"), F.lit(max(1, -(-n // PAIRED)))).alias("_bucket")
    single = single.where("_both").drop("_both").join(n_words, ["_s", "push_id", "kind", "side", "path"], "left").fillna(0, ["n_words"])
    paired = single.select("*", bucket).groupBy("_bucket").cogroup(shared.select("*", bucket).groupBy("_bucket")).applyInPandas(lambda pdf, pairs: _pair(pdf, pairs), CHANGES).unionByName(plain)
    return retyped.unionByName(paired)


def column_types(pushes: DataFrame) -> list[tuple[str, str]]:
    """(path, SQL type) over all files: the type most values have; of numbers bigint if all are 64-bit
    integers, else double; text for arrays. More than ``COLUMNS`` paths are an error."""
    rows = path_stats(pushes).groupBy("path", "kind").agg(F.sum("n").alias("n"), F.sum("ints").alias("ints"))
    kind = F.when(F.col("kind") == "number", F.when(F.col("ints") == F.col("n"), "bigint").otherwise("double")).when(F.col("kind") == "boolean", "boolean").otherwise("string")
    best = rows.groupBy("path").agg(F.min_by(kind, F.struct(-F.col("n"), F.col("kind"))).alias("sql_type")).limit(COLUMNS + 1).collect()
    if len(best) > COLUMNS:
        raise ValueError(f"more than {COLUMNS} paths")
    return sorted((r.path, r.sql_type) for r in best)


def _cast(value: Column, kind: str) -> Column:
    """A value's text in its column's type, null where it doesn't fit: also an integer that a double
    wouldn't hold exactly."""
    out = value.try_cast(kind)
    if kind != "double":
        return out
    whole = F.when(value.rlike(r"^-?\d{16,}$"), value.try_cast("decimal(38,0)"))
    return F.when(F.coalesce(whole == out.try_cast("decimal(38,0)"), ~value.rlike(r"^-?\d{16,}$")), out)


def _maps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for source, push, ts, text in zip(pdf["source"], pdf["push_id"], pdf["ts"], pdf["raw_data"], strict=True):
            try:
                value = parse(text)
            except ValueError:
                value = None
            fields = None
            if isinstance(value, dict):
                fields = {p: v if isinstance(v, str) else json.dumps(v) for p, v in flatten(value)}
            out.append((source, push, ts, fields is not None, fields or {}))
        yield pd.DataFrame(out, columns=["source", "push_id", "ts", "valid", "fields"])


def path_maps(pushes: DataFrame) -> DataFrame:
    """(source, push_id, ts, valid, fields map<path, text>): one row per line, every line kept."""
    lines = push_lines(pushes).select("source", *[F.col(c).cast("string").alias(c) for c in ("push_id", "ts")], "raw_data")
    rows = lines.mapInPandas(_maps, "source string, push_id string, ts string, valid boolean, fields map<string,string>")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("push_id", "ts")})


def _vectors(parts: Iterator[pd.DataFrame], at: dict[str, int]) -> Iterator[pd.DataFrame]:
    for pdf in _maps(parts):
        rows = []
        for fields in pdf["fields"]:
            row: list[str | None] = [None] * len(at)
            for p, v in fields.items():
                if p in at:
                    row[at[p]] = v
            rows.append(row)
        yield pdf.assign(fields=rows)


def consistent_table(pushes: DataFrame, types: list[tuple[str, str]] | None = None) -> DataFrame:
    """One typed table of all lines: source, push_id, ts, valid, a column ``f_<path>`` per path of
    the merged schema, and ``failed``: the paths whose value could not be cast (column null then)."""
    types = column_types(pushes) if types is None else types
    at = {p: i for i, (p, _) in enumerate(types)}
    lines = push_lines(pushes).select("source", *[F.col(c).cast("string").alias(c) for c in ("push_id", "ts")], "raw_data")
    rows = lines.mapInPandas(lambda it: _vectors(it, at), "source string, push_id string, ts string, valid boolean, fields array<string>")
    casts = [(p, F.get("fields", F.lit(i)), _cast(F.get("fields", F.lit(i)), t)) for i, (p, t) in enumerate(types)]
    failed = [F.when(v.isNotNull() & c.isNull(), F.lit(p)) for p, v, c in casts]
    report = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    names = column_names([p for p, _ in types])
    return rows.select("source", *[F.col(c).cast("bigint").alias(c) for c in ("push_id", "ts")], "valid", *[c.alias(n) for n, (_, _, c) in zip(names, casts, strict=True)], report.alias("failed"))


def failed_casts(pushes: DataFrame) -> DataFrame:
    """(path, sql_type, n_failed): per path how many values don't fit its column's type."""
    types = column_types(pushes)
    spark = pushes.sparkSession
    wanted = spark.createDataFrame(types or [("", "")], "path string, sql_type string").where("path <> '' OR sql_type <> ''")
    items = path_maps(pushes).select(F.explode("fields").alias("path", "value")).join(F.broadcast(wanted), "path")
    fits = F.lit(True)
    for kind in ("double", "bigint", "boolean"):
        fits = F.when(F.col("sql_type") == kind, _cast(F.col("value"), kind).isNotNull()).otherwise(fits)
    return items.groupBy("path", "sql_type").agg(F.sum((~fits).cast("bigint")).alias("n_failed"))
