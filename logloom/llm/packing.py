"""Filling fixed-capacity containers (problem 8), by bounded-space online packing.

Items are spread over buckets of about equal size. Each bucket keeps a fixed number of open
windows, places every item best-fit, and emits the fullest window when none fits. What is open
at the end is taken apart and packed again over at most half the buckets, until one closes the
rest; it is as large as its buckets' open windows. An item larger than a container fills containers of its own; its remainder is
an item like any other.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.runtime import cut

#: Open windows per bucket.
WINDOWS = 128
#: Items a bucket is laid out for.
BUCKET = 50_000
#: A window left open at the end is emitted rather than taken apart from this fill on.
FULL = 0.995
OUT = "pack_id bigint, capacity bigint, row bigint, doc_id string, piece_no bigint, n_tokens bigint, container_no bigint, container_tokens bigint, open boolean"


class Windows:
    """Open windows by space left; containers are lists of item positions."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.left: list[tuple[int, int]] = []  # (space left, number), ascending
        self.items: list[list[int]] = []
        self.used: list[int] = []

    def place(self, item: int, size: int) -> None:
        at = bisect.bisect_left(self.left, (size, -1))
        if at < len(self.left):
            space, no = self.left.pop(at)
        else:
            if len(self.left) >= self.most:
                self.left.pop(0)
            space, no = self.capacity, len(self.items)
            self.items.append([])
            self.used.append(0)
        self.items[no].append(item)
        self.used[no] += size
        bisect.insort(self.left, (space - size, no))


def pack_bucket(sizes: list[int], capacity: int, windows: int, last: bool) -> tuple[list[int], list[int], list[bool]]:
    """(container, used, open) of each item: online in the given order; in the last round, which
    has leftovers only, the largest first with every window open."""
    w = Windows(capacity, len(sizes) + 1 if last else windows)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i]) if last else range(len(sizes))
    for i in order:
        w.place(i, sizes[i])
    still = {no for space, no in w.left if not last and w.used[no] < FULL * capacity}
    of, used, opened = [0] * len(sizes), [0] * len(sizes), [False] * len(sizes)
    for no, items in enumerate(w.items):
        for i in items:
            of[i], used[i], opened[i] = no, w.used[no], no in still
    return of, used, opened


def _round(items: DataFrame, number: int, windows: int, most: int) -> tuple[DataFrame, int, bool]:
    n = items.groupBy("pack_id").count().agg(F.max("count")).first()[0] or 0
    buckets = min(most, max(1, -(-n // BUCKET)))
    # the first round is online whatever the input's size
    last = number > 0 and buckets == 1

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "row", "piece_no"])
        bucket = int(pdf["_b"].iloc[0])
        of, used, opened = pack_bucket(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]), windows, last)
        base = (number << 56) + (bucket << 28)
        pdf = pdf.assign(container_no=[base + x for x in of], container_tokens=used, open=opened)
        return pdf.drop(columns=["_h", "_b"])

    h = F.xxhash64("row", F.lit(number))
    keyed = items.withColumn("_h", h).withColumn("_b", F.pmod(h, F.lit(buckets)))
    return cut(keyed.groupBy("pack_id", "_b").applyInPandas(pack, OUT)), buckets, last


def pack(sizes: DataFrame, specs: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(pack_id, doc_id, piece_no, n_tokens, container_no, container_tokens, capacity_tokens).

    ``sizes`` has row, doc_id, n_tokens; ``specs`` pack_id, capacity_tokens, a small table whose
    size is checked. Every item is in exactly one container of each spec; an item over the
    capacity has pieces numbered from 0, all but the last of them containers of their own.
    Containers never hold more than the capacity. Items of size 0 are placed like others; rows
    with equal ids are items of their own; specs without a positive capacity pack nothing.
    """
    known = specs.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 container specifications")
    spec = F.array(*[F.struct(F.lit(r[0]).cast("bigint").alias("pack_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in known])
    if not known:
        spec = F.array().cast("array<struct<pack_id:bigint,capacity:bigint>>")
    kind = dict(sizes.dtypes)["doc_id"]  # ids pass through pandas as text, which keeps nulls and large numbers
    all_of = sizes.select("row", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("_n"), F.explode(spec).alias("_s")).select("_s.*", "row", "doc_id", "_n")
    whole = F.floor(F.col("_n") / F.col("capacity")).cast("bigint")
    full = all_of.where(whole > 0).select("pack_id", "capacity", "row", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece_no"), F.col("capacity").alias("n_tokens"))
    # containers of one piece: numbered by the item, apart from those of the rounds by the sign
    full = full.select("*", (-(F.monotonically_increasing_id() + 1)).alias("container_no"), F.col("n_tokens").alias("container_tokens"), F.lit(False).alias("open"))
    rest = F.col("_n") - whole * F.col("capacity")
    items = all_of.where((rest > 0) | (F.col("_n") == 0)).select("pack_id", "capacity", "row", "doc_id", whole.alias("piece_no"), rest.alias("n_tokens"))
    done, number, most, last = [full], 0, 1 << 27, False
    while not last:
        packed, buckets, last = _round(items, number, windows, most)
        # at most half the buckets of the round before, also where containers are larger than buckets
        most = max(1, buckets // 2)
        done.append(packed.where("NOT open"))
        items, number = packed.where("open").drop("container_no", "container_tokens", "open"), number + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("pack_id", F.col("doc_id").cast(kind).alias("doc_id"), "piece_no", "n_tokens", "container_no", "container_tokens", F.col("capacity").alias("capacity_tokens"))


def fill(packed: DataFrame) -> DataFrame:
    """(pack_id, capacity_tokens, n_containers, n_tokens, fill): how full the containers are."""
    own = packed.groupBy("pack_id", "capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("t"))
    out = own.groupBy("pack_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    return out.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
