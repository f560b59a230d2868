"""Sequence files as ``sequences(file, seq)``, and the manifests that name them.

FASTA and FASTQ are read with Spark's text source, so plain files split and
compressed ones decode natively; no Python touches a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import BROADCAST_ROWS, materialize
from ..validate import require
from .paths import file_key, is_file, qualify, read_key


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, seq``: one row per record, sequence lines joined.

    Records are separated by ``>`` at the start of a line, so only a file's
    first record still carries its ``>``.  A last record that is only a header is
    dropped, an empty one elsewhere stays as an empty sequence (no k-mers, no
    length, so the difference never shows).
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select(
        read_key().alias("file"), F.regexp_replace("value", r"^>", "").alias("rec"))
    body = F.regexp_extract("rec", r"(?s)^[^\n]*\n(.*)$", 1)
    return raw.where(F.contains(F.col("rec"), F.lit("\n"))).select(
        "file", F.regexp_replace(body, r"[\r\n]", "").alias("seq"))


def check_fasta(spark: SparkSession, paths: list[str]) -> None:
    """Every file begins with a header line."""
    starts = spark.read.option("lineSep", "\n>").text(paths).where(
        F.col("_metadata.file_block_start") == 0).groupBy(read_key().alias("file")).agg(
        F.max(F.col("value").startswith(">")).alias("ok"))
    bad = [r[0] for r in starts.where("not ok").limit(10).collect()]
    require(not bad, f"FASTA files that do not start with '>': {bad}")


def read_fastq(spark: SparkSession, paths: list[str], rebalance: bool = False) -> DataFrame:
    """``file, seq``: the second line of every group of four; gzip files included.

    ``rebalance`` deals the records out evenly: a gzip stream is read by one
    task, which must not hash all of it as well.

    A split does not know how many lines precede it, so a first pass counts
    lines per split; the small table of offsets then tells each line its number.
    Both passes plan the same splits of the same files, so a line keeps its id.
    """
    lines = spark.read.text(paths).select(
        read_key().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "fastq")
    odd = splits.groupBy("file").agg(F.sum("n").alias("n")).where("n % 4 != 0").limit(10).collect()
    require(not odd, f"FASTQ files with an incomplete last record: {[r[0] for r in odd]}")
    # the offsets table has one row per input split; the reads must not be shuffled by file for it
    if splits.count() <= BROADCAST_ROWS:
        splits = F.broadcast(splits)
    records = lines.join(splits, ["file", "block"]).where(
        (F.col("offset") + F.col("id") - F.col("first")) % 4 == 1)
    if rebalance:
        records = records.select("file", "id", "value").repartition("id")
    return records.select("file", F.col("value").alias("seq"))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, seq`` of files of any supported type, told apart by their names."""
    require(bool(paths), "no sequence files given")
    by_type: dict[str, list[str]] = {}
    for path in dict.fromkeys(paths):
        by_type.setdefault(X.type_of(path), []).append(path)
    parts = []
    if X.FASTA in by_type:
        check_fasta(spark, by_type[X.FASTA])
        parts.append(read_fasta(spark, by_type[X.FASTA]))
    if X.FASTQ in by_type:
        parts.append(read_fastq(spark, by_type[X.FASTQ]))
    if X.FASTQ_GZ in by_type:
        parts.append(read_fastq(spark, by_type[X.FASTQ_GZ], rebalance=True))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_sequences(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """``sample, seq`` of ``(sample, path)`` pairs; the files of a sample are pooled.

    Paths may be relative or have a scheme; they are compared as full URIs, so that no record misses its sample.
    """
    absent = [p for _, p in files if not is_file(spark, p)]
    require(not absent, f"sequence files that do not exist: {absent[:10]}")
    paths = [qualify(spark, p) for _, p in files]
    owner = spark.createDataFrame([(s, file_key(spark, p)) for s, p in files], "sample string, file string")
    # every record belongs to a listed file: the outer join keeps, and the check below refuses, any that does not
    owner = F.broadcast(owner.distinct()) if len(files) <= BROADCAST_ROWS else owner.distinct()
    owned = read_sequences(spark, paths).join(owner, "file", "left")
    sample = F.coalesce("sample", F.raise_error(F.concat(F.lit("records of a file that is not listed: "), F.col("file"))).cast("string"))
    return owned.select(sample.alias("sample"), "seq")


#: bases per byte of a file, roughly
_BASES_PER_BYTE = {X.FASTA: 1.0, X.FASTQ: 0.4, X.FASTQ_GZ: 1.6}


def estimated_sizes(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """``sample, n_bases`` guessed from file lengths, without reading any file."""
    owner = spark.createDataFrame(
        [(s, file_key(spark, p), _BASES_PER_BYTE[X.type_of(p)]) for s, p in files], "sample string, file string, density double")
    lengths = spark.read.format("binaryFile").load([qualify(spark, p) for _, p in files]).select(read_key().alias("file"), "length")
    # a file of unknown length still has a sample, which starts with the widest bound
    return owner.join(lengths, "file", "left").groupBy("sample").agg(
        F.sum((F.coalesce("length", F.lit(0)) * F.col("density")).cast("bigint")).alias("n_bases"))


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """``sample, files``: manifest lines ``sample<TAB>file[<TAB>file...]``."""
    cols = F.split("value", "\t")
    return spark.read.text(path).where(F.length("value") > 0).select(
        cols[0].alias("sample"), F.slice(cols, 2, F.greatest(F.size(cols) - 1, F.lit(0))).alias("files"))


def library_files(libraries: DataFrame) -> DataFrame:
    return libraries.select("sample", F.explode("files").alias("file"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``path``: a list of paths, one per line."""
    return spark.read.text(path).where(F.length("value") > 0).select(F.col("value").alias("path"))


def header_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, line``: first line of each file that begins with ``>``.

    Line order within a file follows (split, position in the split).
    """
    lines = spark.read.text(paths).select(
        read_key().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value").where(F.col("value").startswith(">"))
    first = lines.groupBy("file").agg(F.min(F.struct("block", "id", "value")).alias("f"))
    return first.select("file", F.col("f.value").alias("line"))


def prepared_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``id, path``: first header word of each listed FASTA file, ``+``, its place in the list."""
    listed = spark.createDataFrame([(i, p, file_key(spark, p)) for i, p in enumerate(paths)], "idx int, path string, file string")
    token = X.header_token(F.col("line"))
    found = listed.join(header_lines(spark, [qualify(spark, p) for p in paths]), "file", "left")
    empty = [r[0] for r in found.where("line is null").select("path").limit(10).collect()]
    require(not empty, f"files without a FASTA header: {empty}")
    return found.select("idx", F.concat_ws("+", token, F.col("idx").cast("string")).alias("id"), "path")
