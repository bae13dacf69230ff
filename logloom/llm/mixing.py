"""Mixing sources to target weights (problem 9), by a time-varying curriculum.

Each source has a schedule: stages of training time, from 0 to 1, with a weight each. The integral
of its weights is its cumulative demand; it is scaled so that the whole of it is what is taken of
the source. A drawn document lies where its source's cumulated tokens meet the demand: the
demand's inverse, piece by piece, gives its training position, and documents are range-sorted by
position. Without a schedule of their own sources get one whose weight goes from 1 - a to 1 + a in
equal stages; these tilts a add up to 0 over the tokens taken, so that the total rate stays even:
sources that are used up further come later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordered import running_sum
from logloom.runtime import cut

#: The steepest schedule goes from 1 - TILT to 1 + TILT times its mean weight.
TILT = 0.5
#: Stages of a schedule that no one gave.
STAGES = 16
#: Target tables up to so many rows are broadcast.
SMALL = 10_000


def demands(sizes: DataFrame, targets: DataFrame, tilt: float = TILT, shrink: bool = False) -> DataFrame:
    """Per mix and source: supply, want, take (tokens) and the schedule's ``a``.

    want = target_share * size_ratio * all tokens of the corpus; take is want, or where that is
    more, supply * max_repeats; what a source lacks is not taken from others. With ``shrink`` the whole
    mix is made smaller instead, until the scarcest of its sources that have documents suffices,
    so that the shares of these keep their proportions. Sources without
    documents, and targets with null or non-positive numbers, take 0.
    """
    targets = targets.select("mix_id", "source", "target_share", "max_repeats", "size_ratio")
    own = sizes.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    t = targets.join(own, "source", "left").withColumns({"supply": F.coalesce("supply", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})
    t = t.withColumn("want", F.coalesce(F.greatest(F.col("target_share"), F.lit(0)) * F.greatest(F.col("size_ratio"), F.lit(0)) * total, F.lit(0.0)))
    most = F.coalesce(F.col("supply") * F.greatest(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("double")
    if shrink:
        scarce = F.min(F.when((F.col("want") > 0) & (most > 0), F.least(F.lit(1.0), F.try_divide(most, F.col("want"))))).over(Window.partitionBy("mix_id"))
        t = t.withColumn("take", F.least(most, F.col("want") * F.coalesce(scarce, F.lit(1.0))))
    else:
        t = t.withColumn("take", F.least("want", most))
    used = F.when(F.col("take") > 0, F.col("take") / (F.col("supply") * F.col("max_repeats"))).otherwise(0.0)
    mix = Window.partitionBy("mix_id")
    mean = F.try_divide(F.sum(used * F.col("take")).over(mix), F.sum("take").over(mix))
    t = t.withColumn("all_take", F.sum("take").over(mix))
    return t.withColumn("a", tilt * (used - F.coalesce(mean, F.lit(0.0))))


def scheduled(demand: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """``demand`` with ``starts``, ``widths`` (of stages) and ``upto``: the integral of the weights
    before each stage and at the end, 1 in all.

    ``schedules`` has mix_id, source, starts_at (from 0 on), weight; a stage goes on to the next
    one's start, the last to 1, before the first the weight is 0. Stages outside [0, 1) and weights
    that are null or negative count as none; a source all of whose weights are 0, or without
    stages, gets the tilt ``a`` of ``demand``. A schedule has few stages; they are kept in arrays.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(STAGES - 1)), lambda i: i / F.lit(float(STAGES)))
    tilted = F.transform(grid, lambda t: F.struct(t.alias("at"), (1 + F.col("a") * (2 * t + 1 / STAGES - 1)).alias("w")))
    if schedules is None:
        x = demand.withColumn("_s", tilted)
    else:
        ok = schedules.where("starts_at >= 0 AND starts_at < 1").select("mix_id", "source", F.col("starts_at").cast("double").alias("at"), F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("w"))
        own = ok.groupBy("mix_id", "source", "at").agg(F.max("w").alias("w")).groupBy("mix_id", "source").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("_own"))
        x = demand.join(own, ["mix_id", "source"], "left")
        x = x.withColumn("_s", F.when(F.exists("_own", lambda s: s["w"] > 0), F.col("_own")).otherwise(tilted)).drop("_own")
    x = x.withColumn("starts", F.transform("_s", lambda s: s["at"]))
    ends = F.concat(F.slice("starts", 2, F.size("_s")), F.array(F.lit(1.0)))
    x = x.withColumn("widths", F.zip_with(ends, "starts", lambda e, b: e - b))
    pieces = F.zip_with("_s", "widths", lambda s, w: s["w"] * w)
    x = x.withColumn("_pieces", pieces).withColumn("_all", F.aggregate("_pieces", F.lit(0.0), lambda m, v: m + v))
    n = F.size("_pieces")
    upto = F.transform(F.sequence(F.lit(0), n), lambda i: F.aggregate(F.slice(F.col("_pieces"), F.lit(1), i), F.lit(0.0), lambda m, v: m + v) / F.col("_all"))
    return x.withColumn("upto", upto).drop("_s", "_pieces", "_all")


def position(u: Column) -> Column:
    """The time at which the share ``u`` of a source's demand has been met."""
    i = F.greatest(F.lit(0), F.least(F.size("starts"), F.size(F.filter("upto", lambda c: c <= u))) - 1)
    low, high = F.get("upto", i), F.get("upto", i + 1)
    return F.get("starts", i) + F.coalesce(F.try_divide(u - low, high - low), F.lit(0.0)) * F.get("widths", i)


def mixture(sizes: DataFrame, targets: DataFrame, tilt: float = TILT, seed: int = 7, shrink: bool = False, schedules: DataFrame | None = None) -> DataFrame:
    """(mix_id, source, doc_id, repeat_no, n_tokens, position, at_token): the drawn documents.

    ``sizes`` has row, doc_id, source, n_tokens. A source is gone through in a pseudo-random but
    fixed order, again from the start when it is exhausted, at most max_repeats times; a document
    is drawn if its middle token lies within what is taken, so that a source misses its tokens by
    half a document at most. ``schedules`` (see ``scheduled``) says when. Further columns are not
    read. ``position`` is in [0, 1], ``at_token`` the same in tokens of the mix. Documents without
    source or tokens are not drawn; rows with equal ids are documents of their own. The result is
    sorted by mix and position.
    """
    t = scheduled(cut(demands(sizes, targets, tilt, shrink)).where("take > 0").select("mix_id", "source", "max_repeats", "supply", "take", "all_take", "a"), schedules)
    docs = sizes.select("row", "doc_id", "source", "n_tokens").where("n_tokens > 0 AND source IS NOT NULL").withColumn("_h", F.xxhash64("row", F.lit(seed)))
    docs = running_sum(docs, ["source"], ["_h", "row"], "n_tokens", "_before")
    small = F.broadcast(t) if t.count() <= SMALL else t
    x = docs.join(small, "source")
    mid = F.col("_before") + F.col("n_tokens") / 2
    times = F.least(F.col("max_repeats").cast("bigint"), (F.floor((F.col("take") - mid) / F.col("supply")) + 1).cast("bigint"))
    x = x.where(mid < F.col("take")).withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    x = x.withColumn("_u", (F.col("repeat_no") * F.col("supply") + mid) / F.col("take"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position(F.col("_u"))))
    x = x.select("mix_id", "source", "doc_id", "repeat_no", "n_tokens", at.alias("position"), "all_take")
    x = x.select("mix_id", "source", "doc_id", "repeat_no", "n_tokens", "position", F.floor(F.col("position") * F.col("all_take")).cast("bigint").alias("at_token"))
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartitionByRange(n, "mix_id", "position", "doc_id").sortWithinPartitions("mix_id", "position", "doc_id", "repeat_no")


def shares(sizes: DataFrame, targets: DataFrame, drawn: DataFrame, shrink: bool = False) -> DataFrame:
    """(mix_id, source, target_share, actual_share, want_tokens, tokens, n_docs, n_draws, most_repeats,
    short): what each target asked for and what it got; a row per target."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_draws"), F.max(F.col("repeat_no") + 1).alias("most_repeats"))
    t = demands(sizes, targets, shrink=shrink).join(got, ["mix_id", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    whole = F.sum(tokens).over(Window.partitionBy("mix_id"))
    return t.select(
        "mix_id", "source", "target_share", F.when(whole > 0, tokens / whole).otherwise(0.0).alias("actual_share"), F.col("want").alias("want_tokens"), tokens.alias("tokens"),
        "n_docs", F.coalesce("n_draws", F.lit(0)).alias("n_draws"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.col("take") < F.col("want")).alias("short"),
    )
