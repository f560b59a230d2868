"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: a word of the size rules: a run without blank or the control characters tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"

#: rows one window partition of :func:`running` holds on average
BUCKET_ROWS = 8192

#: a side of at most so many rows of a few fixed-width columns is broadcast (some tens of MB)
SMALL_ROWS = 200_000

#: bytes of an Arrow batch inside :func:`small_batches`
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column, folds: int, rest: int) -> Column:
    """Whether the crc32 of the id's decimal text leaves ``rest`` modulo ``folds``; null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == rest, F.lit(False))


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that the seed and the columns decide: 52 bits of their MD5."""
    text = F.concat_ws(":", F.lit(seed), *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def small(df: DataFrame) -> DataFrame:
    """A side of a join, to be broadcast if a count shows that it has few rows.

    Beyond that an ordinary join runs, whose skewed partitions the adaptive planner splits.
    """
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of one row per key."""
    return df.join(small(other), keys)


def running(df: DataFrame, group: str, position: str, ties: Sequence[str], size: str) -> DataFrame:
    """Rank and running sum inside groups of any size, without a task per group.

    ``position`` lies in [0, 1) and orders the rows, ``ties`` come next.  A group is cut into buckets of equal
    position width; sums over the few buckets and sums inside a bucket add up.  Adds ``_n`` (rows of the group),
    ``_row`` (rows before, from 0) and ``_before`` (sum of ``size`` before).
    """
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / BUCKET_ROWS)
    cut = beside(df, groups, [group]).withColumn("_b", F.floor(F.col(position) * parts))
    totals = cut.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_rows"), F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(group, "_b", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row0"),
                          F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before0"))
    inside = Window.partitionBy(group, "_b").orderBy(position, *ties)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (cut.join(bases, [group, "_b"])
            .withColumn("_row", F.col("_row0") + F.row_number().over(inside) - 1)
            .withColumn("_before", F.col("_before0") + F.coalesce(F.sum(size).over(above), F.lit(0)))
            .drop("_b", "_row0", "_before0"))


def frugal(*caches: Callable[[], None]) -> Callable:
    """Make a task function give back its worker's memory when its rows are through.

    Spark reuses workers for other stages, and what each has held would add up: the caches are emptied by the functions
    given, and freed memory goes back to the system.
    """
    def wrap(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
        @functools.wraps(task)
        def run(*args, **options) -> Iterator:
            _give_back()
            try:
                yield from task(*args, **options)
            finally:
                for empty in caches:
                    empty()
                _give_back()
        return run
    return wrap


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Spark hands its Python tasks Arrow batches of at most :data:`BATCH_BYTES` (a longer row stands alone) in what runs inside.

    By default a batch has up to 10,000 texts, and the task, its worker and the executor all hold it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def slices_of(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts in ``column`` have about ``size`` bytes; a longer text stands alone.

    A batch of Spark may hold ten thousand texts; what is made of them in Python is kept small by this.
    """
    lengths = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).tolist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def groups_of(texts: Sequence[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of texts whose lengths add up to about ``chars``; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
