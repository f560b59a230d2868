"""Joining positions with the intervals they lie in, by equality alone.

Intervals are cut into aligned blocks of 1, 16, 256 and 4,096 positions, a position belongs to one block of each size,
and blocks are joined by their number.  No interval is listed position by position, nothing compares every position with
every interval, and a block has at most 4,096 positions however long the intervals are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: positions of a block relative to the next smaller one, and the number of sizes beyond single positions
RADIX, SIZES = 16, 3


def _range(start: Column, stop: Column, level: int) -> Column:
    """The blocks from ``start`` to before ``stop``."""
    listed = F.when(start < stop, F.sequence(start, F.greatest(stop - 1, start))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(listed, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))


def _blocks(lo: Column, hi: Column, sizes: int) -> Column:
    parts: list[Column] = []
    for level in range(sizes + 1):
        size = RADIX ** level
        start, stop = F.ceil(lo / size).cast("long"), F.floor((hi + 1) / size).cast("long")
        if level == sizes:
            parts.append(_range(start, stop, level))
            continue
        # what the next size covers is left to it
        inner, outer = F.ceil(lo / (size * RADIX)).cast("long"), F.floor((hi + 1) / (size * RADIX)).cast("long")
        covered = inner < outer
        parts.append(_range(start, F.when(covered, inner * RADIX).otherwise(stop), level))
        parts.append(_range(F.when(covered, outer * RADIX).otherwise(stop), stop, level))
    return F.concat(*parts)


def interval_join(positions: DataFrame, intervals: DataFrame, sizes: int = SIZES, few: bool = False) -> DataFrame:
    """All pairs of ``positions(pos, ...)`` and ``intervals(lo, hi, ...)`` with ``lo <= pos <= hi``, for numbers from 0 on.

    Columns are those of both without ``lo`` and ``hi``; the two sides may share no other name.  ``few`` says that the
    positions were checked to fit a broadcast; then nothing is shuffled and blocks may be larger, ``sizes`` of them.
    """
    own = [c for c in intervals.columns if c not in ("lo", "hi")]
    cut = intervals.select(*own, F.explode(_blocks(F.col("lo").cast("long"), F.col("hi").cast("long"), sizes)).alias("__b")) \
        .select(*own, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("pos") / RADIX ** k).cast("long").alias("block")) for k in range(sizes + 1)))
    placed = positions.select("*", F.explode(levels).alias("__b")).select(*positions.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    # the planner takes an exploded side for as small as its input and would broadcast it
    return placed.hint("broadcast" if few else "merge").join(cut, ["__level", "__block"]).drop("__level", "__block")
