"""Documents to token sequences: language, near duplicates, benchmark passages, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmergrid.llm import decontaminate, langid, minhash, mixing, tokens
from kmergrid.llm.common import table
from kmergrid.llm.queries import folder, vocabulary
from kmergrid.session import materialize

#: the similarity in per cent of the sets of five-word shingles from which on two documents are near copies
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language that the stage learns from its own labelled rows."""
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return minhash.without_duplicates(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take what the mixture draws: part of a document, all of it, or some of it twice."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and return what it holds of each document."""
    out = folder(spark, "sequences")
    tokens.write_sequences(docs, out, vocabulary())
    return tokens.read_documents(spark, out)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: the stages draw, hash and encode in ways that SQL cannot; tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table of documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
