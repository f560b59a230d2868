"""Shards that each hold the corpus mixture, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmergrid.llm.common import running, unit_hash
from kmergrid.session import materialize


def shard(docs: DataFrame, shards: int = 40, seed: str = "shard") -> DataFrame:
    """Deal all documents into ``shards`` shards of equal row counts and equal source shares.

    Inside each source the rows stand in the order of a seeded hash of ``doc_id``; row ``r`` of ``n`` gets the
    fraction ``(r + 0.5) / n``.  Sorting by that fraction interleaves the sources in proportion, and cutting the sorted
    rows into equal pieces gives every shard the mixture up to one row per source.  The law is ``rows``: counts of two
    shards differ by at most one.

    Returns ``doc_id, source, size, text_crc32, law, shard, slot, grown_shard``: size is the UTF-8 length plus 16,
    ``slot`` the place inside the shard from 0, ``grown_shard`` null.  A null text counts as an empty one (size 16,
    checksum 0), a null source is a source of its own.  Rows with the same id stand next to each other in the order
    of checksum and size; equal rows are interchangeable.  With fewer rows than shards the later slots stay empty; an empty
    table gives none.  Other columns are not looked at.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(docs.select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        unit_hash(seed, F.col("doc_id")).alias("_u")), "shard-rows")
    ties = ["doc_id", "text_crc32", "size"]
    ranked = materialize(
        running(slim, "_source", "_u", ties, "size")
        .select("doc_id", "source", "_source", "size", "text_crc32",
                ((F.col("_row") + 0.5) / F.col("_n")).alias("_fraction"), F.lit(0).alias("_all")), "shard-ranks")
    first = F.expr(f"(shard * _n + {shards - 1}L) div {shards}L")
    return (running(ranked, "_all", "_fraction", ["_source", *ties], "size")
            .withColumn("shard", F.expr(f"(_row * {shards}L) div _n"))
            .select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"),
                    F.col("shard").cast("int").alias("shard"), (F.col("_row") - first).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
