"""Ordered processing within keys that may hold any share of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  Here rows are cut into
ranges of (key, order) first, so that a large key spans many ranges; windows run within one
range, and what crosses a range border is settled on one summary row per (key, range).

The borders are taken once, from a bounded sample, and a row's range is a function of its values
and of these borders alone: every use of the rows agrees on it, whichever columns it reads, and
one exchange by (range, key) is enough.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_range"
#: Rows of one range, about.
ROWS = 1 << 20
#: Ranges, at most; beyond that they grow.
MOST = 1 << 15
#: Rows that the borders are taken from, about, at most.
SAMPLED = 1 << 18


def _comparable(df: DataFrame, name: str) -> tuple[Column, str]:
    """A column by which its order can be told from text: (expression, type)."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c, "string"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c), "bigint"
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint"), "bigint"
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint"), "bigint"
    raise TypeError(f"no ranges by {name} of type {kind.simpleString()}")


class Ranges:
    """Ranges of about equal size of the rows of ``df`` in order of (keys, order), nulls first.

    Rows equal in keys and order share a range. There are at least as many ranges as shuffle
    partitions, and more where a range would hold over ``ROWS`` rows.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows: int = ROWS):
        both = [_comparable(df, c) for c in (*keys, *order)]
        self.keys = keys
        self._at = F.struct(*[c.alias(f"c{i}") for i, (c, _) in enumerate(both)])
        self._type = "array<struct<" + ",".join(f"c{i}:{t}" for i, (_, t) in enumerate(both)) + ">>"
        self._key_values = [c for c, _ in both[: len(keys)]]
        at = df.select(self._at.alias("_at"))
        n = at.count()
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(2, parts, min(MOST, -(-n // rows)))
        want = min(SAMPLED, 64 * ranges)
        some = at if n <= want else at.sample(False, want / n, 17)
        got = sorted((tuple(r[0]) for r in some.collect()), key=lambda t: tuple((x is not None, x) for x in t))
        self.borders: list[tuple] = []
        for i in range(1, ranges):
            if got and (b := got[i * len(got) // ranges]) not in self.borders[-1:]:
                self.borders.append(b)

    def _listed(self) -> Column:
        rows = [{f"c{i}": v for i, v in enumerate(b) if v is not None} for b in self.borders]
        return F.from_json(F.lit(json.dumps(rows)), self._type, {"mode": "FAILFAST"})

    def number(self) -> Column:
        """A row's range, found by binary search: how many borders don't lie above it."""
        n = len(self.borders)
        if not n:
            return F.lit(0)
        listed, steps = self._listed(), F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

        def search(at: Column) -> Column:
            def step(low: Column, by: Column) -> Column:
                up = low + by
                return F.when(up > n, low).when(F.get(listed, up - 1) <= at, up).otherwise(low)

            return F.aggregate(steps, F.lit(0), step)

        return F.get(F.transform(F.array(self._at), search), F.lit(0))

    def over(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_range``."""
        return df.withColumn(RANGE, self.number())

    def spanning(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` (which has ``_range``) whose key may have rows in other ranges: the key
        of a border next to their range. At most two keys of each range are left."""
        if not self.borders:
            return df.where(F.lit(False))
        listed = self._listed()

        def key_of(border: Column) -> Column:
            same = F.lit(True)
            for i, v in enumerate(self._key_values):
                same = same & v.eqNullSafe(border[f"c{i}"])
            return border.isNotNull() & same

        below = key_of(F.when(F.col(RANGE) > 0, F.get(listed, F.col(RANGE) - 1)))
        return df.where(below | key_of(F.get(listed, F.col(RANGE))))

    def join(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """``rows`` with what ``carry`` (_range, keys, further columns) holds for their range and key.

        ``carry`` has at most two rows a range (``spanning``), so it is broadcast.
        """
        renamed = carry.withColumnsRenamed({k: f"_r_{k}" for k in (RANGE, *self.keys)})
        cond = rows[RANGE] == renamed[f"_r_{RANGE}"]
        for k in self.keys:
            cond = cond & rows[k].eqNullSafe(renamed[f"_r_{k}"])
        return rows.join(F.broadcast(renamed), cond, "left").drop(*[f"_r_{k}" for k in (RANGE, *self.keys)])


def within(keys: list[str], order: list[str]):
    """The window of one key's rows within one range."""
    return Window.partitionBy(RANGE, *keys).orderBy(*order)


def over_ranges(keys: list[str]):
    """The window of one key's summary rows, one per range."""
    return Window.partitionBy(*keys).orderBy(RANGE)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null (null equals null); the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the key (0 for its first row).

    Rows equal in keys and order are put in an arbitrary but single order; null values count 0.
    """
    v = F.coalesce(F.col(value), F.lit(0))
    cuts = Ranges(df, keys, order)
    x = cuts.over(df)
    local = x.withColumn("_local", F.sum(v).over(within(keys, order).rowsBetween(Window.unboundedPreceding, 0)) - v)
    totals = cuts.spanning(x).groupBy(RANGE, *keys).agg(F.sum(v).alias("_total"))
    base = totals.withColumn("_base", F.sum("_total").over(over_ranges(keys)) - F.col("_total")).drop("_total")
    return cuts.join(local, base).withColumn(out, F.col("_local") + F.coalesce("_base", F.lit(0))).drop("_local", "_base", RANGE)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's place within its key, from 1. Rows equal in order come in any order."""
    cuts = Ranges(df, keys, order)
    x = cuts.over(df)
    local = x.withColumn("_local", F.row_number().over(within(keys, order)).cast("bigint"))
    counts = cuts.spanning(x).groupBy(RANGE, *keys).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.sum("_n").over(over_ranges(keys)) - F.col("_n")).drop("_n")
    return cuts.join(local, base).withColumn(out, F.col("_local") + F.coalesce("_base", F.lit(0))).drop("_local", "_base", RANGE)


def previous(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Add ``prev_<v>`` for each v of ``values`` and ``has_prev``: what the key's row before holds.

    Rows equal in order are ordered by the values.
    """
    cuts = Ranges(df, keys, order)
    x = cuts.over(df)
    whole = [*order, *[v for v in values if v not in order]]
    w, s = within(keys, whole), F.struct(*values)
    local = x.withColumn("_here", F.lag(s).over(w)).withColumn("_rn", F.row_number().over(w))
    last = cuts.spanning(x).groupBy(RANGE, *keys).agg(F.max_by(s, F.struct(*whole)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(over_ranges(keys))).drop("_last")
    out = cuts.join(local, carry).withColumn("_prev", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_here")))
    return out.withColumns({f"prev_{v}": F.col(f"_prev.{v}") for v in values} | {"has_prev": F.col("_prev").isNotNull()}).drop("_here", "_rn", "_carry", "_prev", RANGE)


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the greatest ``value`` of the key's rows up to and with this one (nulls skipped)."""
    cuts = Ranges(df, keys, order)
    x = cuts.over(df)
    local = x.withColumn("_local", F.max(value).over(within(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    tops = cuts.spanning(x).groupBy(RANGE, *keys).agg(F.max(value).alias("_top"))
    carry = tops.withColumn("_carry", F.max("_top").over(over_ranges(keys).rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    return cuts.join(local, carry).withColumn(out, F.greatest("_local", "_carry")).drop("_local", "_carry", RANGE)
