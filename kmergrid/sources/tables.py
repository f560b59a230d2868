"""Readers of the text tables users keep next to their sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hsl
from ..validate import require


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """``idx, value``: lines of a small text file with their position.

    For order files: one name per line, as many lines as drawn rows.  With
    ``comment``, leading lines that start with it are skipped.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"), "value")
    order = Window.partitionBy("f").orderBy("b", "i")
    if comment:
        body = F.max((~F.col("value").startswith(comment)).cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        lines = lines.withColumn("keep", body).where("keep = 1")
    return lines.select((F.row_number().over(order) - 1).cast("int").alias("idx"), "value")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``(a, b, distance)`` above the diagonal, and the names in file order.

    ``path`` is a file, or a folder of part files as :func:`write_matrix` leaves
    them.  Rows are matched to columns by name, so part order is irrelevant.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    header = F.col("value").startswith("$\t")
    head = lines.where(header).first()
    require(head is not None, f"matrix without a header line: {path}")
    names = head[0].split("\t")[1:]
    columns = spark.createDataFrame(list(enumerate(names)), "j int, b string")
    cells = F.split("value", "\t")
    rows = lines.where(~header).select(cells[0].alias("a"), F.slice(cells, 2, F.size(cells)).alias("vals"))
    bad = [r[0] for r in rows.where(F.size("vals") != len(names)).select("a").limit(10).collect()]
    require(not bad, f"matrix rows with an unexpected number of values: {bad}")
    long = rows.select("a", F.posexplode("vals").alias("j", "v")).join(
        columns.select(F.col("b").alias("a"), F.col("j").alias("i")), "a").where("j > i").join(columns, "j")
    # stored pairs are ordered by name elsewhere, here by file position
    value = F.col("v").cast("double")
    return long.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), value.alias("distance")), names


def matrix_names(spark: SparkSession, path: str) -> list[str]:
    """Only the names."""
    head = spark.read.text(path).where(F.col("value").startswith("$\t")).first()
    require(head is not None, f"matrix without a header line: {path}")
    return head[0].split("\t")[1:]


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, mode="FAILFAST")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``leaf, label``; of several lines for a leaf the last counts."""
    cols = F.split("value", "\t")
    lines = numbered_lines(spark, path).where(F.length("value") > 0).select(
        "idx", cols[0].alias("leaf"), cols[1].alias("label"))
    return lines.groupBy("leaf").agg(F.max_by("label", "idx").alias("label"))


def read_colours(spark: SparkSession, path: str | None) -> DataFrame:
    """``label, hue, saturation, lightness, idx, colour``; empty without a file."""
    schema = "label string, hue double, saturation double, lightness double, idx int"
    if path is None:
        rows = spark.createDataFrame([], schema)
    else:
        c = F.split("value", "\t")
        rows = numbered_lines(spark, path).where(F.length("value") > 0).select(
            c[0].alias("label"), c[1].cast("double").alias("hue"), c[2].cast("double").alias("saturation"),
            c[3].cast("double").alias("lightness"), "idx")
        rows = rows.groupBy("label").agg(*[F.max_by(x, "idx").alias(x) for x in ("hue", "saturation", "lightness")],
                                         F.max("idx").alias("idx"))
    return rows.withColumn("colour", hsl(F.col("hue"), F.col("saturation"), F.col("lightness")))


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """``name, rank``."""
    return numbered_lines(spark, path).select(F.col("value").alias("name"), F.col("idx").alias("rank"))


def read_node_report(spark: SparkSession, path: str, max_width: float = 1.0) -> DataFrame:
    """``id, name, weight`` of a query report, weights scaled to line widths."""
    rows = _tsv(spark, path, "id int, name string, weight double", header=True)
    return rows.withColumn("weight", F.col("weight") * F.lit(float(max_width)))


def read_label_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``name, label, weight`` of label reports; each file must be about one query."""
    rows = spark.read.csv(paths, sep="\t", schema="name string, label string, weight double", header=True, mode="FAILFAST") \
        .select("*", F.col("_metadata.file_path").alias("__file"))
    mixed = rows.groupBy("__file").agg(F.countDistinct("name").alias("n")).where("n != 1").limit(10).collect()
    require(not mixed, f"label reports with several names: {[r[0] for r in mixed]}")
    return rows.drop("__file")


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """``idx, line`` of a scheduler template."""
    return numbered_lines(spark, path).select("idx", F.col("value").alias("line"))


def read_sketches(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(sketch, meta)`` of stored sketch sets."""
    root = [p.rstrip("/") for p in paths]
    return (spark.read.parquet(*[f"{p}/sketch" for p in root]),
            spark.read.parquet(*[f"{p}/meta" for p in root]))


def read_kmer_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tree, kmer_lca, tree_meta)`` of a stored k-mer tree."""
    root = path.rstrip("/")
    return tuple(spark.read.parquet(f"{root}/{part}") for part in ("tree", "kmer_lca", "tree_meta"))


def read_bucketed_lca(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """``hash, node_id`` of files that were written with the same number of buckets.

    Spark knows buckets from its catalog only, so the folder is entered there under a name of its own.  The hint keeps
    the planner from broadcasting or hashing a small tree; a merge join takes the buckets as they lie.
    """
    name = f"kmer_lca_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (hash INT, node_id INT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name).hint("merge")


def sketch_map(paths: DataFrame) -> DataFrame:
    """``stem, path``: stored sketches by file stem, which must be unique."""
    from ..functions.text import file_stem
    named = paths.select(file_stem(F.col("path")).alias("stem"), "path")
    twice = [r[0] for r in named.groupBy("stem").count().where("count > 1").limit(10).collect()]
    require(not twice, f"file stems that appear more than once: {twice}")
    return named
