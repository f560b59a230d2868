"""The commands as jobs over stored tables: files in, tables and reports out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import validate as V
from ..config import DistanceConfig, LabelDrawing, QueryConfig, SketchConfig, TreeDrawing
from ..functions.text import fill_template
from ..operators import classify as C
from ..operators import distance as D
from ..operators import label_matrix as L
from ..operators import linkage, sketch as K
from ..operators import tree as T
from ..operators.dendrogram import dendrogram_tree
from ..session import materialize
from ..sinks import drawing, tables as out
from ..sources import newick, paths as P, sequences as src, tables


# --- sketches ----------------------------------------------------------------

def sketch(spark: SparkSession, files: list[tuple[str, str]], output: str, config: SketchConfig) -> None:
    """Sketch all ``(sample, path)`` pairs in one job; ``sample`` is only a grouping key.

    Assemblies report their exact size; for reads a guess is enough to steer the
    first pass, so their files are not read an extra time.
    """
    records = src.sample_sequences(spark, files)
    sizes = materialize(K.sample_sizes(records) if config.assembly else src.estimated_sizes(spark, files), "sizes")
    sketches = materialize(K.build_sketches(records, config, sizes), "sketch")
    out.write_sketches(sketches, K.sketch_meta(sketches, sizes, config), output)
    if config.track_cov:
        out.write_coverages(K.coverage_histogram(sketches), f"{output.rstrip('/')}/coverages")


def manifest(spark: SparkSession, path: str, skip_missing: bool = False) -> tuple[list[tuple[str, str]], list[str]]:
    """``(sample, file)`` pairs of a manifest, and the samples left out for missing files.

    A manifest is a list of paths the driver needs anyway to plan the scan.
    """
    rows = src.read_libraries(spark, path).collect()
    skipped = [r.sample for r in rows if not all(P.is_file(spark, f) for f in r.files)]
    V.require(skip_missing or not skipped, f"samples with missing files: {skipped[:V.SHOWN]}")
    left_out = set(skipped)
    return [(r.sample, f) for r in rows if r.sample not in left_out for f in r.files], skipped


def sketch_command(files: Column, sample: Column, program: str, output: str, config: SketchConfig) -> Column:
    """The command line that sketches one sample, as a Column."""
    flags = (" --assembly" if config.assembly else "") + (" --track-cov" if config.track_cov else "")
    return F.concat(F.concat_ws(
        " ", F.lit(program), F.lit("sketch"), F.lit("--seq-files"), F.array_join(files, ","),
        F.lit("--kmer-size"), F.lit(str(config.kmer_size)), F.lit("--sketch-size"), F.lit(str(config.sketch_size)),
        F.lit("--min-cov"), F.lit(str(config.min_cov)), F.lit("--name"), sample,
        F.lit("-o"), F.concat(F.lit(output.rstrip("/") + "/"), sample)), F.lit(flags))


def scripts(libraries: DataFrame, template: DataFrame, program: str, output: str, config: SketchConfig) -> DataFrame:
    """``sample, idx, line``: the scheduler template filled in for every sample."""
    text = [(r.idx, r.line) for r in template.orderBy("idx").collect()]
    folder = F.concat(F.lit(output.rstrip("/") + "/"), F.col("sample"))
    filled = F.array(*[F.struct(F.lit(i).alias("idx"), fill_template(
        F.lit(t), F.concat(folder, F.lit("/"), F.col("sample"), F.lit(".out")), F.col("command")).alias("line"))
        for i, t in text])
    command = sketch_command(F.col("files"), F.col("sample"), program, output, config)
    return libraries.withColumn("command", command).select("sample", F.explode(filled).alias("f")).select("sample", "f.*")


# --- distances ---------------------------------------------------------------

def _ordered_names(meta: DataFrame) -> DataFrame:
    """``idx, name`` in name order; one row per matrix column."""
    ordered = meta.agg(F.sort_array(F.collect_list("sample")).alias("s"))
    return ordered.select(F.posexplode("s").alias("idx", "name"))


def distance(spark: SparkSession, sketches: list[str], output: str, jaccard: bool = False) -> None:
    sketch_table, meta = tables.read_sketches(spark, sketches)
    k, size, count = V.sketch_set(meta)
    largest = meta.agg(F.max("sketch_size")).first()[0]
    pairs = D.pairwise(sketch_table, DistanceConfig(k, jaccard), count, largest, meta.select("sample"))
    names = materialize(_ordered_names(meta), "names")
    out.write_matrix(D.matrix_rows(pairs, names), names, output)


def update(spark: SparkSession, matrix: str, old: list[str], new: list[str], output: str) -> None:
    known, names = tables.read_matrix(spark, matrix)
    old_sketch, old_meta = tables.read_sketches(spark, old)
    new_sketch, new_meta = tables.read_sketches(spark, new)
    k, _, _ = V.update_inputs(old_meta, new_meta)
    V.same_names(names, old_meta)
    pairs = D.update(known, old_sketch, new_sketch, DistanceConfig(k), old_meta.select("sample"), new_meta.select("sample"))
    added = _ordered_names(new_meta).select((F.col("idx") + len(names)).alias("idx"), "name")
    order = materialize(
        spark.createDataFrame(list(enumerate(names)), "idx int, name string").unionByName(added), "names")
    out.write_matrix(D.matrix_rows(pairs, order), order, output)


# --- trees -------------------------------------------------------------------

def build_tree(spark: SparkSession, tree_file: str, sketches: list[str] | None, output: str) -> None:
    """K-mer tree from a Newick file; without sketches it is only good for drawing."""
    _store_tree(spark, newick.load_newick(spark, tree_file), sketches, output)


def population_tree(spark: SparkSession, matrix: str, sketches: list[str] | None, output: str) -> None:
    """K-mer tree over the single-linkage clustering of a distance matrix."""
    distances, names = tables.read_matrix(spark, matrix)
    if sketches:
        _, meta = tables.read_sketches(spark, sketches)
        V.require(V.sketch_set(meta)[2] == len(names), "not every matrix column has a sketch")
    _store_tree(spark, materialize(dendrogram_tree(linkage.spanning_tree(distances)), "tree"), sketches, output)


def _store_tree(spark: SparkSession, tree: DataFrame, sketches: list[str] | None, output: str) -> None:
    if sketches:
        sketch_table, meta = tables.read_sketches(spark, sketches)
        k, size, _ = V.sketch_set(meta)
        lca = C.kmer_lca(sketch_table, tree)
        tree = C.with_genome_sizes(tree, meta)
    else:
        k, size = 0, 0
        lca = spark.createDataFrame([], "hash int, node_id int")
        tree = tree.withColumn("genome_size", F.lit(0).cast("bigint"))
    info = spark.createDataFrame([(size, k)], "min_sketch_size int, kmer_length int")
    out.write_kmer_tree(tree, lca, info, output)


def tree_metrics(spark: SparkSession, kmer_tree: str, output: str) -> None:
    tree, lca, _ = tables.read_kmer_tree(spark, kmer_tree)
    report = C.tree_metrics(lca, tree).select(
        F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("nodes").alias("Nodes"),
        F.col("leafs").alias("Leafs"), F.col("kmers").alias("Kmers"))
    out.write_report(report, output, "Kmers", "ID")


# --- queries -----------------------------------------------------------------

def query(spark: SparkSession, kmer_tree: str, sketches: list[str], output: str, labels: str | None = None,
          config: QueryConfig = QueryConfig(), joint_name: str | None = None) -> None:
    """Classify all given sketches in one job, each on its own or pooled under ``joint_name``.

    Writes ``nodes``, ``summary`` and, with labels, ``labels``; one folder per query.
    """
    tree, lca, info = tables.read_kmer_tree(spark, kmer_tree)
    queries, meta = tables.read_sketches(spark, sketches)
    stored = info.first()
    V.query_inputs(meta, stored.min_sketch_size, stored.kmer_length)
    trimmed, listed = C.trim(queries.select("sample", "hash"), stored.min_sketch_size), meta.select("sample")
    if joint_name is not None:
        trimmed, listed = C.pooled(trimmed, joint_name), spark.createDataFrame([(joint_name,)], "sample string")
    hit = materialize(C.hits(trimmed, lca, listed), "hits")
    root = output.rstrip("/")
    report = C.node_report(hit, tree).select(
        "sample", F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("weight").alias("Weight"))
    out.write_report(report, f"{root}/nodes", F.col("Weight").desc(), F.col("ID"), by="sample")
    out.write_report(C.explained(hit), f"{root}/summary", "sample")
    if labels is not None:
        table = tables.read_labels(spark, labels)
        V.labels_cover(tree, table)
        weights = materialize(C.node_label_weights(tree, table), "node-labels")
        scores = C.label_scores(hit, weights, C.root_of(tree), config.normalize)
        rows = scores.select(F.col("name").alias("sample"), F.col("name").alias("Name"),
                             F.col("label").alias("Label"), F.col("weight").alias("Weight"))
        out.write_report(rows, f"{root}/labels", "Label", by="sample")


# --- drawings ----------------------------------------------------------------

def draw_tree(spark: SparkSession, kmer_tree: str, output: str, config: TreeDrawing, colours: str | None = None,
              report: str | None = None, matrix: str | None = None) -> None:
    tree, _, _ = tables.read_kmer_tree(spark, kmer_tree)
    node_colours = widths = distances = None
    if colours:
        table = tables.read_colours(spark, colours)
        V.colours_cover(tree, table)
        node_colours = T.uniform_colour(tree, table.select(
            F.col("label").alias("name"), drawing.css(F.col("colour")).alias("colour")))
    if report:
        widths = L.branch_widths(tables.read_node_report(spark, report), config.line_width, config.min_frequency)
    if matrix:
        distances, names = tables.read_matrix(spark, matrix)
        V.matrix_covers(tree, names)
    drawing.draw_tree(tree, output, config, widths, node_colours, distances)


def draw_labels(spark: SparkSession, reports: list[str], colours: str, output: str, config: LabelDrawing,
                order: str | None = None) -> None:
    """``output.svg`` and the proportions in ``output.query.matrix``."""
    palette = tables.read_colours(spark, colours)
    labels = materialize(L.ordered_labels(palette, config.normalize), "labels")
    names = [r.label for r in labels.orderBy("idx").collect()]
    report = tables.read_label_report(spark, reports)
    prepared = materialize(L.prepare(report, config.normalize, config.min_proportion), "prepared")
    checked = L.label_counts(prepared).where(F.col("total") > 0)
    wrong = [r.name for r in checked.where(F.col("labels") != len(names)).limit(V.SHOWN).collect()]
    V.require(not wrong, f"queries without exactly {len(names)} labels: {wrong}")
    V.proportions_sum_to_one(prepared)
    drawn = _report_names(spark, reports)
    if order:
        wanted = {r.name: r.rank for r in tables.read_order(spark, order).collect()}
        absent = [n for n in drawn if n not in wanted]
        V.require(not absent, f"queries missing from the order file: {absent[:V.SHOWN]}")
        drawn = sorted(drawn, key=wanted.get)
    queries = spark.createDataFrame([(n, i) for i, n in enumerate(drawn)], "name string, rank int")
    css = palette.select("label", drawing.css(F.col("colour")).alias("colour"))
    drawing.draw_label_bars(L.offsets(prepared, labels, config.width), queries, css, output + ".svg", config)
    out.write_label_matrix(L.wide(prepared, names), output + ".query.matrix", queries)


def _report_names(spark: SparkSession, reports: list[str]) -> list[str]:
    """Query names in the order of the given report files."""
    rows = spark.read.csv(reports, sep="\t", schema="name string, label string, weight double", header=True).select(
        P.read_key().alias("file"), "name").distinct().collect()
    order = {P.file_key(spark, p).rstrip("/"): i for i, p in enumerate(reports)}

    def rank(file: str) -> int:
        return order.get(file, order.get(os.path.dirname(file), len(order)))

    return [r.name for r in sorted(rows, key=lambda r: rank(r.file))]
