"""Hash counts of sequences that keep arriving.

Counts of disjoint inputs add up, so each micro-batch stores its own counts and
the sketch is taken from their sum; no state has to be held between batches.  A
batch writes to a folder named after its id, so a batch repeated after a failure
replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SketchConfig
from ..operators.kmers import kmers
from ..operators.sketch import hash_counts, to_sketch


def sequence_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``sample, seq`` rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema("sample string, seq string") \
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def store_counts(stream: DataFrame, output: str, checkpoint: str, k: int) -> StreamingQuery:
    """Count all files present, batch by batch, then stop."""
    root = output.rstrip("/")

    def save(batch: DataFrame, batch_id: int) -> None:
        hash_counts(kmers(batch, k)).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, output: str) -> DataFrame:
    """Counts over all batches so far."""
    parts = spark.read.parquet(output)
    rep = "km" if "km" in parts.columns else "kmer"
    return parts.groupBy("sample", "hash").agg(F.sum("cnt").alias("cnt"), F.min(rep).alias(rep))


def current_sketch(spark: SparkSession, output: str, config: SketchConfig) -> DataFrame:
    return to_sketch(stored_counts(spark, output), config)
