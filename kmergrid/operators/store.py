"""Stored summaries of samples that new input is merged into, without reading old input again.

A summary of some input of a sample is
    counts(sample, hash, cnt, km)          every distinct hash up to the bound, the rarely seen ones too
    bounds(sample, bound, n_bases, ...)    one row: what the counts reach up to, the input's length, the settings

The bound is the largest hash of the sketch if that is full, otherwise there is none (the largest integer).  Below
the smallest bound of several summaries their added counts are those of all input together.  The summary that has this
bound fills a sketch below it by itself, and adding input never makes a hash rarer, so the sketch of all input lies
below it, too: merged sketches are exact, whatever the least coverage, and so are merges of merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SketchConfig
from ..functions import murmur
from ..session import BROADCAST_ROWS, materialize
from .kmers import kmer_counts
from .sketch import INT_MAX, bottom, build_sketches, hash_counts, sample_sizes, to_sketch, well_covered

#: settings that summaries must share to be merged
SETTINGS = ("kmer_size", "sketch_size", "min_cov", "assembly")


def _settings(config: SketchConfig) -> dict[str, object]:
    return {"kmer_size": config.kmer_size, "sketch_size": config.sketch_size,
            "min_cov": config.effective_min_cov, "assembly": config.assembly}


def _bounded(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of ``df(sample, ...)`` with their sample's bound, which is broadcast below a checked number of samples."""
    side = bounds.select("sample", "bound")
    return df.join(F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side, "sample")


def _reach(counts: DataFrame, config: SketchConfig) -> DataFrame:
    """``sample, top``: the largest hash of each full sketch."""
    kept = bottom(well_covered(counts, config), config.sketch_size).groupBy("sample")
    return kept.agg(F.count(F.lit(1)).alias("__n"), F.max("hash").alias("top")).where(F.col("__n") == config.sketch_size).select("sample", "top")


def summarize(sequences: DataFrame, config: SketchConfig) -> tuple[DataFrame, DataFrame]:
    """``counts, bounds`` of ``sequences(sample, seq)``.

    The sketch gives the bound; a second look at the input counts what lies below it, so that only a small multiple of
    the sketch is shuffled for a sample that fills it.  A sample without any window has a row in ``bounds`` alone.
    """
    if config.kmer_size > murmur.BASES_PER_LONG:
        raise ValueError(f"summaries hold k-mers of at most {murmur.BASES_PER_LONG} bases")
    sizes = materialize(sample_sizes(sequences), "sizes")
    sketch = build_sketches(sequences, config, sizes)
    full = sketch.groupBy("sample").agg(F.count(F.lit(1)).alias("__n"), F.max("hash").alias("__top"))
    bound = F.when(F.col("__n") == config.sketch_size, F.col("__top")).otherwise(F.lit(INT_MAX))
    bounds = materialize(sizes.join(full, "sample", "left").select(
        "sample", bound.alias("bound"), "n_bases", *(F.lit(v).alias(k) for k, v in _settings(config).items())), "bounds")
    counts = hash_counts(kmer_counts(_bounded(sequences.select("sample", "seq"), bounds), config.kmer_size, "bound"))
    return materialize(counts.select("sample", "hash", "cnt", "km"), "counts"), bounds


def merge(counts: DataFrame, bounds: DataFrame, config: SketchConfig) -> tuple[DataFrame, DataFrame]:
    """One summary per sample from the rows of any number of summaries.

    Summaries with other settings cannot be merged and are refused.
    """
    wanted = _settings(config)
    other = [F.col(k) != F.lit(wanted[k]) for k in SETTINGS]
    strange = bounds.where(other[0] | other[1] | other[2] | other[3]).select("sample", *SETTINGS).first()
    if strange is not None:
        raise ValueError(f"the summary of {strange['sample']} has other settings: {strange.asDict()}, not {wanted}")
    low = materialize(bounds.groupBy("sample").agg(F.min("bound").alias("bound"), F.sum("n_bases").alias("n_bases")), "low")
    added = (_bounded(counts, low).where(F.col("hash") <= F.col("bound")).groupBy("sample", "hash")
             .agg(F.sum("cnt").alias("cnt"), F.min("km").alias("km")))
    added = materialize(added, "added")
    merged = materialize(low.join(_reach(added, config), "sample", "left").select(
        "sample", F.coalesce("top", "bound").alias("bound"), "n_bases", *(F.lit(wanted[k]).alias(k) for k in SETTINGS)), "bounds")
    kept = _bounded(added, merged).where(F.col("hash") <= F.col("bound"))
    return kept.select("sample", "hash", "cnt", "km"), merged


def append(path: str, counts: DataFrame, bounds: DataFrame) -> None:
    """Add a summary to the store at ``path``; the bounds come last, so that counts without a bound are no summary."""
    counts.write.mode("append").parquet(f"{path.rstrip('/')}/counts")
    bounds.write.mode("append").parquet(f"{path.rstrip('/')}/bounds")


def load(spark: SparkSession, path: str, config: SketchConfig) -> tuple[DataFrame, DataFrame]:
    """The merged summaries of the store at ``path``."""
    root = path.rstrip("/")
    return merge(spark.read.parquet(f"{root}/counts"), spark.read.parquet(f"{root}/bounds"), config)


def compact(spark: SparkSession, path: str, target: str, config: SketchConfig) -> None:
    """Write the store at ``path`` with one summary per sample to a new place."""
    append(target, *load(spark, path, config))


def stored_sketch(spark: SparkSession, path: str, config: SketchConfig) -> DataFrame:
    """``sketch(sample, hash, coverage, kmer)`` of everything that was added to the store at ``path``."""
    counts, _ = load(spark, path, config)
    return to_sketch(counts, config)
