"""Deeply nested records into related flat tables (problem 2).

A merged schema is inferred over all records first: the array paths that occur (``*`` for an
ordinal) and the fields and types of the objects in them. Then array level after array level is
exploded along the schema's paths, each object becoming a row of its path's child table with the
key of its line, its own JSON Pointer as surrogate key, its parent's pointer and its ordinal in
the array. Validity by RFC 8259 is checked on the way to the schema, as Spark's parser is laxer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsonpath import child
from logloom.runtime import column_names, cut

#: Rows of fields that are handed on at a time.
ROWS = 50_000
#: Array levels, and names and ordinals of a path, that are exploded; lines with more are walked.
LEVELS, STEPS = 32, 64
#: Array paths of a merged schema, at most; of lines with names as keys beyond that all are walked.
PATHS = 1000
NODES = "_line string, path string, pointer string, parent string, ordinal bigint, fields string"


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """The value of a JSON text by RFC 8259 (no NaN, no trailing text); ValueError if it is none.

    Of repeated names in one object the last holds. Valid texts beyond Python's limits count
    as invalid too: nested past its parser's recursion (5,000 levels parse, 20,000 don't) or with
    an integer of more than 4,300 digits.
    """
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _step(name: str) -> str:
    """A name within an array path, where * stands for an ordinal."""
    return escape(name) if name != "*" else "~2"


def _name(step: str) -> str:
    return "*" if step == "~2" else step.replace("~1", "/").replace("~0", "~")


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint" if -(1 << 63) <= v < 1 << 63 else "double"
    return {float: "double", str: "string", list: "array", dict: "object"}[type(v)]


def objects(value) -> Iterator[tuple[str, str, str, int, dict]]:
    """(path, pointer, parent, ordinal, object) of each object that is an element of an array."""
    todo = [(value, "", "", "", -1)]
    while todo:
        v, path, pointer, parent, at = todo.pop()
        if isinstance(v, dict):
            if at >= 0:
                yield path, pointer, parent, at, v
                parent = pointer
            for k, x in v.items():
                if isinstance(x, dict | list):
                    todo.append((x, f"{path}/{_step(k)}", f"{pointer}/{escape(k)}", parent, -1))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict | list):
                    todo.append((x, f"{path}/*", f"{pointer}/{i}", parent, i))


def _at_leaves(o: dict) -> Iterator[tuple[tuple[str, ...], object]]:
    """The fields of one object by the names that lead there, objects within opened, arrays left whole."""
    todo: list[tuple[tuple[str, ...], dict]] = [((), o)]
    while todo:
        p, d = todo.pop()
        for k, v in d.items():
            if isinstance(v, dict) and v:
                todo.append(((*p, k), v))
            else:
                yield (*p, k), v


def _leaves(o: dict) -> Iterator[tuple[str, object]]:
    """The same by dotted name."""
    for at, v in _at_leaves(o):
        yield ".".join(at), v


def _infer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[tuple[str, tuple, str], int] = {}

    def out() -> pd.DataFrame:
        rows = [(path, ".".join(at), json.dumps(at), kind, n) for (path, at, kind), n in seen.items()]
        seen.clear()
        return pd.DataFrame(rows, columns=["path", "field", "at", "kind", "n"])

    for pdf in parts:
        for text in pdf["_json"]:
            try:
                value = parse(text)
            except ValueError:
                continue
            for path, _, _, _, o in objects(value):
                for at, v in _at_leaves(o):
                    key = (path, at, _kind(v))
                    seen[key] = seen.get(key, 0) + 1
        if len(seen) > 100_000:
            yield out()
    if seen:
        yield out()


def _fields(df: DataFrame, body: Column) -> DataFrame:
    return df.select(body.alias("_json")).mapInPandas(_infer, "path string, field string, at string, kind string, n bigint")


def merged_schema(df: DataFrame, body: Column) -> DataFrame:
    """(path, field, kind, n): the fields of the objects in each array path with how often each
    type occurs. Invalid JSON and null have no part in it."""
    return _fields(df, body).groupBy("path", "field", "kind").agg(F.sum("n").alias("n"))


def _explode(parts: Iterator[pd.DataFrame], with_fields: bool) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for line, text in zip(pdf["_line"], pdf["_json"], strict=True):
            try:
                value = parse(text)
            except ValueError:
                continue
            for path, pointer, parent, at, o in objects(value):
                fields = json.dumps(o, ensure_ascii=False) if with_fields else None
                out.append((line, path, pointer, parent, at, fields))
        yield pd.DataFrame(out, columns=["_line", "path", "pointer", "parent", "ordinal", "fields"])


def _with_lines(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    # arrays of objects need a bracket and a brace: other lines needn't reach Python
    some = df.where(F.col(body).contains("[") & F.col(body).contains("{"))
    return some.select(F.to_json(F.array(*[F.col(k).cast("string") for k in keys]), {"ignoreNullFields": "false"}).alias("_line"), F.col(body).alias("_json"))


def _keys_back(df: DataFrame, keys: list[str]) -> list[Column]:
    types = dict(df.select(*keys).dtypes)
    line = F.from_json("_line", "array<string>")
    return [line[i].cast(types[k]).alias(k) for i, k in enumerate(keys)]


def _prepare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The valid lines with objects in arrays: text anew (of repeated names the last), whether they are
    too deep to explode, and else their array paths."""
    for pdf in parts:
        out = []
        for line, text in zip(pdf["_line"], pdf["_json"], strict=True):
            try:
                value = parse(text)
            except ValueError:
                continue
            paths = {o[0] for o in objects(value)}
            if paths:
                deep = any(len(s) > STEPS or s.count("*") > LEVELS for s in (p.split("/")[1:] for p in paths))
                out.append((line, json.dumps(value, ensure_ascii=False), deep, [] if deep else list(paths)))
        yield pd.DataFrame(out, columns=["_line", "_json", "deep", "paths"])


def _level_of(path: str) -> tuple[str, list[str]]:
    """(path of the array element above, names from there to the array) of an array path."""
    steps = path.split("/")[1:-1]
    at = max((i for i, s in enumerate(steps) if s == "*"), default=-1) + 1
    return "".join(f"/{s}" for s in steps[:at]), [_name(s) for s in steps[at:]]


def _levels(paths: list[str]) -> list[list[str]]:
    """The array paths by level, those included that only lead to others."""
    every = set(paths)
    for p in paths:
        while (p := _level_of(p)[0]):
            every.add(p)
    by: dict[int, list[str]] = {}
    for p in sorted(every):
        by.setdefault(sum(s == "*" for s in p.split("/")), []).append(p)
    return [by[k] for k in sorted(by)]


def _next_level(rows: DataFrame, paths: list[str]) -> DataFrame:
    """The elements, objects and arrays, of the arrays that ``paths`` lead to from ``rows``
    (_line, path, pointer, below, v); ``below`` is the parent pointer of what lies below a row."""
    arrays = []
    for p in paths:
        above, names = _level_of(p)
        at = F.col("v")
        for name in names:
            at = child(at, name)
        got = F.when(F.col("path") == above, F.try_variant_get(at, "$", "array<variant>"))
        arrays.append(F.struct(F.lit(p).alias("path"), F.lit("".join(f"/{escape(n)}" for n in names)).alias("rel"), got.alias("items")))
    x = rows.select("_line", "pointer", "below", F.explode(F.filter(F.array(*arrays), lambda a: a["items"].isNotNull())).alias("_a"))
    x = x.select("_line", F.col("_a.path").alias("path"), F.concat("pointer", "_a.rel").alias("_array"), "below", F.posexplode("_a.items").alias("ordinal", "v"))
    kind = F.substring(F.schema_of_variant("v"), 1, 5)
    x = x.select("_line", "path", F.concat("_array", F.lit("/"), F.col("ordinal").cast("string")).alias("pointer"), F.col("below").alias("parent"), F.col("ordinal").cast("bigint").alias("ordinal"), "v", kind.alias("_kind")).where("_kind IN ('OBJEC', 'ARRAY')")
    return x.withColumn("below", F.when(F.col("_kind") == "OBJEC", F.col("pointer")).otherwise(F.col("parent")))


def child_nodes(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(_line, path, pointer, parent, ordinal, fields): each object that is an element of an array of
    the JSON text ``body``, at any depth; ``fields`` is its JSON.

    The merged schema's array paths tell what is exploded at each level; every level is written
    once to the shared folder, where the next one starts.
    """
    ready = cut(_with_lines(df, body, keys).mapInPandas(_prepare, "_line string, _json string, deep boolean, paths array<string>"))
    names = ready.select(F.explode("paths").alias("path")).distinct().limit(PATHS + 1).collect()  # as large as the schema
    paths = [r.path for r in names] if len(names) <= PATHS else []
    parsed = F.try_parse_json("_json")
    walked = F.lit(True) if len(names) > PATHS else F.col("deep") | parsed.isNull()
    found = ready.where(walked).mapInPandas(lambda it: _explode(it, True), NODES)
    rows = ready.where(~walked).select("_line", F.lit("").alias("path"), F.lit("").alias("pointer"), F.lit("").alias("below"), parsed.alias("v"))
    for level in _levels(paths):
        rows = cut(_next_level(rows, level))
        found = found.unionByName(rows.where("_kind = 'OBJEC'").select("_line", "path", "pointer", "parent", "ordinal", F.to_json("v").alias("fields")))
    return found


def nested_objects(df: DataFrame, body: str, keys: list[str], with_fields: bool = False) -> DataFrame:
    """(keys, path, pointer, parent, ordinal, fields): the rows of all child tables: each object that
    is an element of an array of the JSON text ``body``, at any depth.

    ``parent`` is the pointer of the nearest enclosing object that is itself an array element,
    else ''. Null, empty and invalid texts have no objects; strings that hold JSON stay strings.
    Records equal in ``keys`` each give their rows. Columns of ``df`` outside ``keys`` and
    ``body`` are not read, so clashing names do no harm.
    """
    found = child_nodes(df, body, keys)
    return found.select(*_keys_back(df, keys), "path", "pointer", "parent", "ordinal", "fields" if with_fields else F.lit(None).cast("string").alias("fields"))


def _field_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["_line", "path", "pointer", "parent", "ordinal", "field", "kind", "value"]
    out = []
    for pdf in parts:
        for line, text in zip(pdf["_line"], pdf["_json"], strict=True):
            try:
                value = parse(text)
            except ValueError:
                continue
            for path, pointer, parent, at, o in objects(value):
                own = (line, path, pointer, parent, at)
                for name, v in _leaves(o):
                    out.append((*own, name, _kind(v), v if v is None or isinstance(v, str) else json.dumps(v)))
                if not o:
                    out.append((*own, None, None, None))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
    yield pd.DataFrame(out, columns=names)


def child_rows(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(path, keys, pointer, parent, ordinal, field, kind, value): the child tables of every array
    path in one, a row per object and field; an object without fields has one row with null field.

    ``value`` is the text of a string, the JSON of any other value, and null for null.
    """
    found = _with_lines(df, body, keys).mapInPandas(_field_rows, NODES.replace("fields string", "field string, kind string, value string"))
    return found.select("path", *_keys_back(df, keys), "pointer", "parent", "ordinal", "field", "kind", "value")


def _column_type(kinds: list[str]) -> str:
    real = sorted({k for k in kinds if k != "null"})
    if len(real) == 1 and real[0] in ("bigint", "double", "boolean", "string"):
        return real[0]
    return "double" if real == ["bigint", "double"] else "string"


def _typed(v: Column, kind: str) -> Column:
    if kind != "string":
        return F.try_variant_get(v, "$", kind)
    # text as it is; of other values their JSON, of null nothing
    text = F.to_json(v)
    return F.when(text.startswith('"'), F.try_variant_get(v, "$", "string")).when(text != "null", text)


def child_tables(df: DataFrame, body: str, keys: list[str]) -> dict[str, DataFrame]:
    """One flat table per array path: keys, pointer, parent, ordinal, and a typed column ``f_<name>``
    per field of the merged schema (text where types conflict or the value is an array).

    The objects are written once to the shared folder; each table reads its path's part.
    """
    nodes = cut(nested_objects(df, body, keys, with_fields=True))
    # paths whose objects are all empty have no fields, but rows
    fields: dict[str, dict[str, tuple[str, list[str]]]] = {r.path: {} for r in nodes.select("path").distinct().collect()}
    kinds = _fields(df, F.col(body)).groupBy("path", "field", "at", "kind").agg(F.sum("n").alias("n"))
    for r in kinds.collect():  # as large as the schema, not the data
        fields.setdefault(r.path, {}).setdefault(r.at, (r.field, []))[1].append(r.kind)
    out = {}
    for path, own in fields.items():
        t = nodes.where(F.col("path") == path).withColumn("_v", F.try_parse_json("fields"))
        ats = sorted(own, key=lambda at: (own[at][0], at))
        typed = []
        for at, name in zip(ats, column_names([own[at][0] for at in ats]), strict=True):
            v = F.col("_v")
            for step in json.loads(at):
                v = child(v, step)
            typed.append(_typed(v, _column_type(own[at][1])).alias(name))
        out[path] = t.select(*keys, "pointer", "parent", "ordinal", *typed)
    return out
