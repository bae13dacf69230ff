"""Per-key results where a handful of keys hold most rows (problem 7).

Method: dense accumulator arrays. Each input split dictionary-encodes its keys and
scatter-reduces its rows with numpy into dense arrays, one cell per position, an array per block
of positions. The arrays of one block are summed up (here: by their maximum) through a
distributed reduction, running maxima inside a block are taken on its array, and the same is done
once more on the blocks' tops for what comes before a block. Rows look their answer up in the
array of their block: no window and no task ever holds a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.runtime import cut

#: Cells of an array.
BLOCK = 1024
#: Cells that a split holds before it hands its arrays on.
CELLS = 1 << 22
NONE = int(np.iinfo(np.int64).min)
ARRAYS = "_key string, _block bigint, _first bigint, _cells array<bigint>"


def _scatter(parts: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """The dense arrays of one split, each from its first to its last cell in use."""
    arrays: dict[tuple, np.ndarray] = {}

    def out() -> pd.DataFrame:
        rows = []
        for (key, at), cells in arrays.items():
            used = np.flatnonzero(cells > NONE)
            if len(used):
                rows.append((key, at, int(used[0]), cells[used[0] : used[-1] + 1]))
        arrays.clear()
        return pd.DataFrame(rows, columns=["_key", "_block", "_first", "_cells"])

    for pdf in parts:
        if pdf.empty:
            continue
        codes, names = pd.factorize(pdf["_key"], use_na_sentinel=False)
        at = pdf["_order"].to_numpy(np.int64)
        which, known = pd.factorize(pd.MultiIndex.from_arrays([codes, at // block]))
        # a batch's blocks in slices, so that sparse keys don't need a cell per position at once
        order, most = np.argsort(which, kind="stable"), max(1, CELLS // block)
        bounds = np.searchsorted(which[order], np.arange(0, len(known) + most, most))
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            rows = order[lo:hi]
            base = k * most
            cells = np.full((min(most, len(known) - base), block), NONE, np.int64)
            np.maximum.at(cells, (which[rows] - base, at[rows] % block), pdf["_value"].to_numpy(np.int64)[rows])
            for (c, b), own in zip(known[base : base + most], cells, strict=True):
                key = (names[c] if isinstance(names[c], str) else None, int(b))
                if key in arrays:
                    np.maximum(arrays[key], own, out=arrays[key])
                else:
                    arrays[key] = own.copy()
            if len(arrays) >= most:
                yield out()
    if arrays:
        yield out()


def _reduce(parts: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Arrays that come block by block, reduced to one a block; per cell the greatest value of the
    block's earlier cells, and the top of all."""
    now, cells = None, np.full(block, NONE, np.int64)

    def done() -> tuple:
        running = np.maximum.accumulate(cells)
        return (*now, np.concatenate(([NONE], running[:-1])), int(running[-1]))

    for pdf in parts:
        out = []
        for key, at, first, part in zip(pdf["_key"], pdf["_block"], pdf["_first"], pdf["_cells"], strict=True):
            if now != (key, at):
                if now is not None:
                    out.append(done())
                now = (key, at)
                cells.fill(NONE)
            own = cells[first : first + len(part)]
            np.maximum(own, part, out=own)
        yield pd.DataFrame(out, columns=["_key", "_block", "_before", "_top"])
    if now is not None:
        yield pd.DataFrame([done()], columns=["_key", "_block", "_before", "_top"])


def _running(rows: DataFrame, block: int) -> DataFrame:
    """(_key, _block, _before, _top) of (_key, _order, _value): per block the running maxima of its
    cells before each cell, and its own maximum."""
    arrays = rows.mapInPandas(lambda it: _scatter(it, block), ARRAYS)
    met = arrays.repartition("_key", "_block").sortWithinPartitions("_key", "_block")
    return met.mapInPandas(lambda it: _reduce(it, block), "_key string, _block bigint, _before array<bigint>, _top bigint")


def _same(x: DataFrame, y: DataFrame, at: Column) -> Column:
    return x["_key"].eqNullSafe(y["_k"]) & (at == y["_b"])


def late_rows(df: DataFrame, key: str = "source", order: str = "seq", value: str = "ts", block: int = BLOCK) -> DataFrame:
    """Rows of ``df`` (key, order, value, behind) that some row of the same key with a smaller
    ``order`` exceeds in ``value``; ``behind`` is by how much at most.

    Null keys form one key of their own. Rows whose order or value is null are neither late nor
    make others late. Rows equal in (key, order) don't affect each other. An empty table gives
    no rows; further columns of ``df`` are not read.

    A task of the reduction holds the arrays of one block, one per split that has rows of it; of a
    key's blocks only every ``block``-th top meets in one window.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(order).cast("bigint").alias("_order"), F.col(value).cast("bigint").alias("_value"))
    rows = rows.where("_order IS NOT NULL AND _value IS NOT NULL")
    # written once: the arrays answer for their cells, their tops go one level up
    blocks = cut(_running(rows, block))
    tops = blocks.select("_key", F.col("_block").alias("_order"), F.col("_top").alias("_value"))
    over = _running(tops, block)
    before = F.max("_top").over(Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    over = over.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.col("_before").alias("_over"), before.alias("_far"))
    at = F.floor(F.col("_block") / block).cast("bigint")
    carried = blocks.join(over, _same(blocks, over, at))
    carry = F.greatest(F.get("_over", F.pmod("_block", F.lit(block)).cast("int")), "_far")
    carried = carried.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), "_before", carry.alias("_carry"))
    x = rows.join(carried, _same(rows, carried, F.floor(F.col("_order") / block).cast("bigint")))
    top = F.greatest(F.get("_before", F.pmod("_order", F.lit(block)).cast("int")), "_carry")
    return x.where(top > F.col("_value")).select(F.col("_key").alias(key), F.col("_order").alias(order), F.col("_value").alias(value), (top - F.col("_value")).alias("behind"))


def _bincount(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        if pdf.empty:
            continue
        codes, names = pd.factorize(pdf["_key"], use_na_sentinel=False)
        n = np.bincount(codes, minlength=len(names))
        has = pdf["_value"].notna().to_numpy()
        v = pdf["_value"].fillna(0).to_numpy(np.int64)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, codes, v)
        yield pd.DataFrame({"_key": [x if isinstance(x, str) else None for x in names], "n": n, "n_value": np.bincount(codes[has], minlength=len(names)), "total": total})


def key_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, n_value, total): rows, rows with a value, and the sum of an integer column per key.

    Each split adds its rows up in dense arrays, one cell per key of the split, so that the
    exchange carries one row per key and split. Null keys are one key; an empty table gives none.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("bigint").alias("_value"))
    parts = rows.mapInPandas(_bincount, "_key string, n bigint, n_value bigint, total bigint")
    return parts.groupBy(F.col("_key").alias(key)).agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("total").alias("total"))
