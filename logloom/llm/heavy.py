"""Most frequent items (problem 3), exactly and in bounded memory, by prefix refinement.

Items are hashed to 64 bits. Counting by the first bits of the hash needs few counters; the
count of a prefix bounds the count of each of its items from above, so only prefixes that reach
the bound are kept and lengthened, until whole values remain.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.runtime import cut

#: Bits of the hash that each round counts by.
ROUNDS = (12, 26, 44)
#: So many prefixes may be listed in a filter; more of them are joined.
LISTED = 4096


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("_h", 64 - bits)


def _keep(rows: DataFrame, prefixes: DataFrame, bits: int, n: int) -> DataFrame:
    if n <= LISTED:
        known = [r[0] for r in prefixes.select("_p").collect()]
        return rows.where(_prefix(bits).isin(known)) if known else rows.where(F.lit(False))
    return rows.withColumn("_p", _prefix(bits)).join(prefixes.select("_p"), "_p", "left_semi").drop("_p")


def _refine(values: DataFrame, bound: int, k: int | None) -> DataFrame:
    """(item, n) of the items that reach ``bound`` or, with ``k``, may be among the k first."""
    hashes = cut(values.select("_h"))
    kept, rows = values, hashes
    for bits in ROUNDS:
        counts = cut(rows.groupBy(_prefix(bits).alias("_p")).agg(F.count(F.lit(1)).alias("n")))
        if k is not None:
            # the k largest prefixes, opened to whole hashes, give a lower bound for the k-th item
            largest = counts.orderBy(F.desc("n"), "_p").limit(k)
            opened = _keep(rows, largest, bits, min(k, LISTED)) if k <= LISTED else rows.join(largest.select("_p"), _prefix(bits) == F.col("_p"), "left_semi")
            best = opened.groupBy("_h").count().orderBy(F.desc("count")).limit(k).agg(F.count(F.lit(1)), F.min("count")).first()
            if best[0] >= k:
                bound = max(bound, best[1])
        alive = counts.where(F.col("n") >= bound)
        n = alive.count()
        rows, kept = _keep(rows, alive, bits, n), _keep(kept, alive, bits, n)
    return kept.groupBy(F.col("_v").alias("item")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound)


def _values(df: DataFrame, value: Column) -> DataFrame:
    v = df.select(value.alias("_v")).where(F.col("_v").isNotNull())
    return v.withColumn("_h", F.xxhash64("_v"))


def frequent(df: DataFrame, value: Column, share: float, total: int) -> DataFrame:
    """(item, n): every non-null value that makes up at least ``share`` of ``total``; counts are exact.

    At most 1/share prefixes survive a round. ``total`` 0 gives no rows.
    """
    if total <= 0:
        return _values(df, value).where(F.lit(False)).groupBy(F.col("_v").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    bound = math.ceil(Fraction(repr(share)) * total)  # 0.01 * 700 is more than 7 in doubles
    return _refine(_values(df, value), max(1, bound), None)


def most_frequent(df: DataFrame, value: Column, k: int) -> DataFrame:
    """(item, n): the ``k`` most frequent non-null values, ties by value; counts are exact."""
    return _refine(_values(df, value), 1, k).orderBy(F.desc("n"), "item").limit(k)
