"""Frequency of every distinct term (problem 1), by a vertical layout.

Every term owns a compressed bitmap of record identifiers: the identifiers are dense row numbers,
a bitmap is stored as its non-zero 64-bit words, and each word carries a counter of occurrences
beside it. Words are merged by union (``bit_or``) and counters by addition, on the map side
first; the document frequency of a term is the cardinality of its bitmap.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_words(df: DataFrame, terms: Column) -> DataFrame:
    """(term, word, bits, occ): the bitmap words of every term.

    Every row of ``df`` is one record, rows equal in all columns too. Null and empty terms are
    left out; null arrays and empty arrays have no terms.
    """
    rid = F.monotonically_increasing_id()
    rows = df.select(rid.alias("_rid"), terms.alias("_terms"))
    kept = F.filter("_terms", lambda t: t.isNotNull() & (t != ""))
    occ = rows.select("_rid", F.explode(kept).alias("term"))
    return occ.groupBy("term", F.shiftrightunsigned("_rid", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_rid & 63 AS INT))")).alias("bits"), F.count(F.lit(1)).alias("occ")
    )


def term_frequencies(df: DataFrame, terms: Column) -> DataFrame:
    """(term, n_occurrences, n_records) for every distinct term; an empty table gives no rows."""
    return term_words(df, terms).groupBy("term").agg(F.sum("occ").alias("n_occurrences"), F.sum(F.bit_count("bits")).cast("bigint").alias("n_records"))


def marked_terms(df: DataFrame, terms: Column, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """``term_frequencies`` with ``mark``: ``rare`` below ``rare_below`` records, ``common`` above
    ``common_share`` of the records whose array is not null (empty ones included), else null.

    A term that is both (a tiny collection) is ``rare``.
    """
    n = df.where(terms.isNotNull()).count()
    share = Fraction(repr(common_share))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * share.denominator > share.numerator * n, "common")
    return term_frequencies(df, terms).withColumn("mark", mark)
