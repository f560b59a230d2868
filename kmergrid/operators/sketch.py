"""Bottom-s sketches: count hashes, keep the well-covered, keep the s smallest.

Tables
    sequences(sample, seq, ...)            input records
    hash counts(sample, hash, cnt, km)     one row per distinct hash of a sample
    sketch(sample, hash, coverage, kmer)   at most s rows per sample
    meta(sample, kmer_length, genome_size, sketch_size)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SketchConfig
from ..functions import numeric
from ..functions import sequence as S
from ..session import BROADCAST_ROWS, allow_group_limit, materialize
from .kmers import kmer_counts

INT_MIN, INT_MAX = -2147483648, 2147483647

#: tasks a single sample's candidates are spread over before the final cut
SALTS = 64

#: hash occurrences a first pruned pass admits, in multiples of the sketch size
FIRST_PASS_ASSEMBLY = 4
FIRST_PASS_READS = 128
#: how much wider each following pass is for the samples that fell short
WIDEN = 64
#: samples from which on one shuffle by sample serves the counts and the cut
MANY = 1000


def hash_counts(hashed: DataFrame) -> DataFrame:
    """Occurrences per sample and hash, with one representative k-mer.

    Two k-mers may share a 32-bit hash; the smaller stands for both.  With
    packed k-mers every buffer is fixed width, so this is a plain hash
    aggregate with map-side combining.
    """
    rep = "km" if "km" in hashed.columns else "kmer"
    cnt = F.sum("cnt") if "cnt" in hashed.columns else F.count(F.lit(1))
    return hashed.groupBy("sample", "hash").agg(cnt.alias("cnt"), F.min(rep).alias(rep))


def well_covered(counts: DataFrame, config: SketchConfig) -> DataFrame:
    return counts.where(F.col("cnt") >= config.effective_min_cov)


def bottom(df: DataFrame, size: int, by: str = "sample", order: str = "hash",
           salts: int = SALTS) -> DataFrame:
    """The ``size`` rows with the smallest ``order`` per group, ``order`` unique in a group.

    The planner prunes every partition to ``size`` rows per group before each
    shuffle.  One group may still span all partitions, so its survivors are
    first reduced in ``salts`` independent slices and only the winners of those
    meet in one task.
    """
    allow_group_limit(df.sparkSession, size)
    columns = df.columns

    def cut(frame: DataFrame, *keys) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return frame.withColumn("__rn", rank).where(F.col("__rn") <= size)

    if salts > 1:
        df = cut(df.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(salts))), by, "__salt")
    return cut(df, by).select(*columns)


def to_sketch(counts: DataFrame, config: SketchConfig, salts: int = SALTS) -> DataFrame:
    """Hash counts to ``sketch(sample, hash, coverage, kmer)``.

    Tracked coverage of an assembly is one above the count: a first sighting
    there is recorded as two.
    """
    kept = bottom(well_covered(counts, config), config.sketch_size, salts=salts)
    coverage = (F.col("cnt") + int(config.assembly)).cast("int") if config.track_cov else F.lit(0)
    kmer = S.unpack(F.col("km"), config.kmer_size) if "km" in counts.columns else F.col("kmer")
    return kept.select("sample", "hash", coverage.alias("coverage"), kmer.alias("kmer"))


def sample_sizes(sequences: DataFrame) -> DataFrame:
    """``sample, n_bases``: total length, unknown bases and short records included."""
    return sequences.groupBy("sample").agg(F.sum(F.length("seq").cast("bigint")).alias("n_bases"))


def _least(config: SketchConfig) -> int | None:
    """How many hashes of a piece of a sample can matter: all, where a k-mer must be seen more than once."""
    return config.sketch_size if config.effective_min_cov == 1 else None


def sketch_plan(sequences: DataFrame, config: SketchConfig) -> DataFrame:
    """The sketch as one lazy plan without a bound on the hash."""
    return to_sketch(hash_counts(kmer_counts(sequences, config.kmer_size, least=_least(config))), config)


def record_sketches(sequences: DataFrame, config: SketchConfig) -> DataFrame:
    """:func:`sketch_plan` for many samples of few records each, as one lazy plan.

    Where every k-mer counts, a task hands on no more than a sketch of what it reads of a sample, so no bound on the
    hash is needed, and one shuffle by sample serves the counts and the cut.
    """
    if _least(config) is None:
        return build_sketches(sequences, config)
    found = kmer_counts(sequences, config.kmer_size, least=config.sketch_size)
    return to_sketch(hash_counts(found.repartition("sample")), config, salts=1)


def build_sketches(sequences: DataFrame, config: SketchConfig,
                   sizes: DataFrame | None = None) -> DataFrame:
    """The same sketch, counting only hashes that can make the cut.

    Only a sliver of the hash range ends up in a sketch, yet counting
    everything would shuffle every k-mer of the input.  Each sample gets an
    upper bound on the hash from its size, hashes above it are dropped in the
    map stage, and the result is exact for each sample that filled its sketch
    (all hashes below the bound were seen).  Samples that fell short are redone
    with a bound ``WIDEN`` times higher, in the end without one.

    ``sizes(sample, n_bases)`` only steers the bound; any estimate will do.
    """
    first = FIRST_PASS_ASSEMBLY if config.assembly else FIRST_PASS_READS
    share = F.lit(float(first) * config.sketch_size) / F.greatest(F.col("n_bases"), F.lit(1))
    sizes = sizes if sizes is not None else sample_sizes(sequences)
    bounds = materialize(sizes.select("sample", share.alias("share")), "bounds")

    done = []
    while True:
        bounds = bounds.select(
            "sample", "share",
            F.when(F.col("share") >= 1.0, F.lit(INT_MAX)).otherwise(
                (F.lit(float(INT_MIN)) + F.col("share") * 4294967296.0).cast("int")).alias("bound"))
        side = bounds.select("sample", "bound")
        # one small row per sample; beyond the limit the planner joins as it sees fit
        samples = bounds.count()
        if samples <= BROADCAST_ROWS:
            side = F.broadcast(side)
        found = kmer_counts(sequences.join(side, "sample"), config.kmer_size, "bound", _least(config))
        if samples >= MANY:
            found = found.repartition("sample")
        part = materialize(to_sketch(hash_counts(found), config, salts=1), "sketch")

        filled = part.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
        short = materialize(
            bounds.where(F.col("bound") < INT_MAX).join(filled, "sample", "left")
            .where(F.coalesce("n", F.lit(0)) < config.sketch_size)
            .select("sample", (F.col("share") * WIDEN).alias("share")), "bounds")
        if short.isEmpty():
            done.append(part)
            break
        done.append(part.join(short, "sample", "left_anti"))
        bounds = short
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def sketch_meta(sketch: DataFrame, sizes: DataFrame, config: SketchConfig) -> DataFrame:
    """One row per sample, also for samples whose sketch came out empty."""
    per = sketch.groupBy("sample").agg(
        F.count(F.lit(1)).cast("int").alias("__n"), F.max("hash").alias("__top"))
    size = F.col("n_bases") if config.assembly else \
        numeric.estimate_genome_size(F.col("__top"), config.sketch_size)
    return sizes.join(per, "sample", "left").select(
        "sample", F.lit(config.kmer_size).alias("kmer_length"), size.alias("genome_size"),
        F.coalesce("__n", F.lit(0)).alias("sketch_size"))


def coverage_histogram(sketch: DataFrame) -> DataFrame:
    """``sample, coverage, kmers``."""
    return sketch.groupBy("sample", "coverage").agg(F.count(F.lit(1)).alias("kmers"))


def coverage_stats(sketch: DataFrame) -> DataFrame:
    """Mean, population standard deviation and median of the coverage.

    The exact median only needs one weighted value per distinct coverage.  The
    deviation is Spark's own, from the rows: a difference of second moments loses all
    digits where coverages are large and close together.
    """
    rows = sketch.select("sample", F.col("coverage").cast("double").alias("coverage"))
    moments = rows.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("mean"), F.stddev_pop("coverage").alias("std_dev"))
    hist = coverage_histogram(sketch).withColumn("coverage", F.col("coverage").cast("double"))
    medians = hist.groupBy("sample").agg(F.expr("percentile(coverage, 0.5D, kmers)").alias("median"))
    return moments.join(medians, "sample").select("sample", "n", "mean", "std_dev", "median")

