"""Writers.  Tables go to Parquet, reports to TSV folders of ordered part files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sketches(sketch: DataFrame, meta: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sketch set: ``path/sketch`` clustered by sample and hash, ``path/meta``.

    Sorting by hash inside a file lets a lookup by hash skip row groups.
    """
    root = path.rstrip("/")
    sketch.repartitionByRange("sample", "hash").sortWithinPartitions("sample", "hash") \
        .write.mode(mode).parquet(f"{root}/sketch")
    meta.write.mode(mode).parquet(f"{root}/meta")


def write_kmer_tree(tree: DataFrame, lca: DataFrame, meta: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A k-mer tree: ``path/{tree,kmer_lca,tree_meta}``; the hash table is range-clustered."""
    root = path.rstrip("/")
    tree.write.mode(mode).parquet(f"{root}/tree")
    lca.repartitionByRange("hash").sortWithinPartitions("hash").write.mode(mode).parquet(f"{root}/kmer_lca")
    meta.write.mode(mode).parquet(f"{root}/tree_meta")


def write_bucketed_lca(lca: DataFrame, path: str, buckets: int) -> None:
    """The hash table of a k-mer tree in ``buckets`` files by hash, each sorted, for :func:`~.sources.tables.read_bucketed_lca`.

    Queries then come to the tree: a join by hash shuffles the query sketches alone.  A bucket is one task of that
    join, so their number should leave some hundred MB to each.
    """
    spark, name = lca.sparkSession, f"kmer_lca_{uuid.uuid4().hex}"
    lca.repartition(buckets, "hash").write.bucketBy(buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files of an external table stay


def write_report(df: DataFrame, path: str, *order, header: bool = True, by: str | None = None,
                 mode: str = "errorifexists") -> None:
    """A TSV report in the given order; ``by`` puts each of its values in a folder of its own."""
    if by:
        # one folder per value; rows of a value are ordered inside its files
        out = df.repartition(by).sortWithinPartitions(by, *order).write.partitionBy(by)
    else:
        out = df.orderBy(*order).write
    out.mode(mode).csv(path, sep="\t", header=header, nullValue="", emptyValue="")


def write_coverages(histogram: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``sample, coverage, kmers`` without header, coverage ascending within a sample."""
    write_report(histogram, path, "sample", "coverage", header=False, mode=mode)


def matrix_lines(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``idx, value``: text lines of a matrix, header first (``idx`` -1)."""
    body = rows.select("idx", F.concat_ws("\t", F.col("name"),
                                          F.array_join(F.transform("row", lambda v: v.cast("string")), "\t")).alias("value"))
    head = names.agg(F.sort_array(F.collect_list(F.struct("idx", "name"))).alias("n")).select(
        F.lit(-1).alias("idx"), F.concat_ws("\t", F.lit("$"), F.array_join(F.col("n.name"), "\t")).alias("value"))
    return head.unionByName(body)


def write_matrix(rows: DataFrame, names: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Matrix lines in order over the part files; concatenated they are the matrix file."""
    matrix_lines(rows, names).orderBy("idx").select("value").write.mode(mode).text(path)


def write_label_matrix(wide: DataFrame, path: str, order: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Label proportions, one row per query, in query order."""
    if order is not None:
        wide = wide.join(order, "name").orderBy("rank").drop("rank")
    else:
        wide = wide.orderBy("name")
    wide.write.mode(mode).csv(path, sep="\t", header=True)


def write_scripts(scripts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per sample with its scheduler script lines."""
    scripts.repartition("sample").sortWithinPartitions("sample", "idx").select("sample", F.col("line").alias("value")) \
        .write.mode(mode).partitionBy("sample").text(path)
