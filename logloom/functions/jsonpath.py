"""JSON paths, scalars and flattening as column expressions on VARIANT.

A dotted path is resolved by trying, at each object, the shortest run of the remaining segments
that is a key, and descending for good on the first hit. The choice is expanded at plan time
into nested CASE expressions, so that it stays inside generated code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: More segments than this would make an expression of more than 2^7 branches.
MOST_SEGMENTS = 8
_FLOAT = r"^[+-]?(?i:inf|infinity|nan|(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?)$"


def body(raw: Column) -> Column:
    """The parsed text; null if it is no JSON. Spark's rules hold: an object with a repeated name
    is invalid, text after the value is not looked at."""
    return F.try_parse_json(raw)


def child(v: Column, key: str) -> Column:
    """The value under a literal key; SQL null if absent or ``v`` is no object."""
    if "?" in key or ("'" in key and '"' in key):
        return F.try_variant_get(v, "$", "map<string,variant>")[key]
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def resolve(v: Column, path: str) -> Column:
    """The value (VARIANT) at a dotted path, SQL null if absent; a JSON null is present."""
    segments = path.split(".")
    if len(segments) > MOST_SEGMENTS:
        raise ValueError(f"a path of more than {MOST_SEGMENTS} segments: {path}")

    def go(at: Column, rest: list[str]) -> Column:
        out = None
        for n in range(len(rest), 0, -1):
            hit = child(at, ".".join(rest[:n]))
            found = hit if n == len(rest) else go(hit, rest[n:])
            out = F.when(hit.isNotNull(), found) if out is None else F.when(hit.isNotNull(), found).otherwise(out)
        return out

    return go(v, segments)


def present(v: Column, path: str) -> Column:
    return resolve(v, path).isNotNull()


def _canonical(number: Column) -> Column:
    """Decimal text without a trailing .0 and without exponent, however small or large."""
    part = lambda i: F.regexp_extract(number, r"^(-?)(\d+)(?:\.(\d*?))?0*[eE]([+-]?\d+)$", i)
    sign, whole, rest, e = part(1), part(2), part(3), part(4).try_cast("int")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - F.length(whole)), whole, rest)
    large = F.when(e >= F.length(rest), F.concat(sign, whole, rest, F.repeat(F.lit("0"), e - F.length(rest)))).otherwise(F.concat(sign, whole, F.substring(rest, F.lit(1), e), F.lit("."), F.substring(rest, e + 1, F.length(rest))))
    plain = F.when(number.rlike("[eE]"), F.when(e < 0, small).otherwise(large)).otherwise(number)
    return F.regexp_replace(plain, r"\.0+$", "")


def scalar_text(v: Column) -> Column:
    """A string as it is, a number, boolean or null as text; SQL null for absent, object, array."""
    s = F.to_json(v)
    first = F.substring(s, 1, 1)
    return F.when(first == '"', F.try_variant_get(v, "$", "string")).when(~first.isin("{", "["), F.when(first.isin("t", "f", "n"), s).otherwise(_canonical(s)))


def group_text(v: Column) -> Column:
    """``scalar_text``, and the two characters "" for an absent value, object or array."""
    return F.coalesce(scalar_text(v), F.lit('""'))


def numeric(v: Column) -> Column:
    """A JSON number, or a string that reads as one without spaces or suffix; else SQL null."""
    s = F.to_json(v)
    first = F.substring(s, 1, 1)
    text = F.try_variant_get(v, "$", "string")
    return F.when((first == '"') & text.rlike(_FLOAT), text.try_cast("double")).when(first.rlike(r"[-\d]"), s.try_cast("double"))


def flatten_pairs(value: dict) -> Iterator[tuple[str, list[str]]]:
    """(dotted key, leaves as text) of an object; an array gives all its leaves to its own key."""

    def text(x) -> str:
        if isinstance(x, float) and x == x and abs(x) != float("inf"):
            plain = format(Decimal(repr(x)), "f")
            return plain.rstrip("0").rstrip(".") if "." in plain else plain
        return x if isinstance(x, str) else json.dumps(x)

    def leaves(x, key: str, out: dict[str, list[str]]) -> None:
        if isinstance(x, dict):
            for k, y in x.items():
                leaves(y, f"{key}.{k}" if key else k, out)
        elif isinstance(x, list):
            for y in x:
                leaves(y, key, out)
        else:
            out.setdefault(key, []).append(text(x))

    out: dict[str, list[str]] = {}
    leaves(value, "", out)
    yield from out.items()


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def flatten(raw: pd.Series) -> pd.Series:
    """Dotted keys to their leaves for a JSON object; null for anything else."""

    def one(t):
        try:
            v = json.loads(t) if isinstance(t, str) else None
            return dict(flatten_pairs(v)) if isinstance(v, dict) else None
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def object_keys(raw: Column) -> Column:
    """The dotted keys through objects, arrays being leaves: what a shipper sends as json_keys."""
    return _keys(raw)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(raw: pd.Series) -> pd.Series:
    def walk(d, pre=""):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from walk(v, f"{pre}{k}.")
            else:
                yield f"{pre}{k}"

    def one(t):
        try:
            v = json.loads(t) if isinstance(t, str) else None
            return list(walk(v)) if isinstance(v, dict) else None
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def with_body(df: DataFrame) -> DataFrame:
    return df.withColumn("body", body(F.col("raw_data")))
