"""Command line: one sub-command per workflow."""

from __future__ import annotations

import argparse

from ..config import LabelDrawing, QueryConfig, SketchConfig, TreeDrawing
from ..session import build_session
from ..sinks.tables import write_scripts
from ..sources import sequences as src, tables
from ..sources import paths as P
from ..validate import require
from . import workflows as W


def _sketch_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output", required=True, help="output folder")
    p.add_argument("--assembly", action="store_true", help="input is assemblies: keep every k-mer")
    p.add_argument("--min-cov", type=int, default=2, help="occurrences a k-mer of reads needs (default 2)")
    p.add_argument("--kmer-size", type=int, default=21)
    p.add_argument("--sketch-size", type=int, default=100_000)
    p.add_argument("--track-cov", action="store_true", help="record k-mer coverage")


def _sketch_config(a: argparse.Namespace) -> SketchConfig:
    return SketchConfig(a.kmer_size, a.sketch_size, a.min_cov, a.assembly, a.track_cov)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmergrid", description="k-mer sketch analytics on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("sketch", help="sketch one sample")
    p.add_argument("-s", "--seq-files", required=True, help="comma-separated FASTA, FASTQ or FASTQ.GZ files")
    p.add_argument("--name", required=True, help="sample name")
    _sketch_options(p)

    p = sub.add_parser("sketch-serially", help="sketch all samples of a manifest in one job")
    p.add_argument("-l", "--libraries", required=True, help="lines of sample<TAB>file[<TAB>file]")
    _sketch_options(p)

    p = sub.add_parser("sketch-cluster", help="write one scheduler script per sample of a manifest")
    p.add_argument("-l", "--libraries", required=True)
    p.add_argument("--program", default="spark-submit -m kmergrid", help="how to start this tool on a node")
    p.add_argument("--cluster-config", help="template with $STDOUT and $COMMAND")
    _sketch_options(p)

    p = sub.add_parser("distance", help="distance matrix of sketches")
    p.add_argument("--sketches", required=True, help="file of sketch folders, one per line")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--jd", action="store_true", help="Jaccard distance instead of Mash distance")

    p = sub.add_parser("update", help="add sketches to a distance matrix")
    p.add_argument("-m", "--matrix", required=True)
    p.add_argument("-e", "--existing-sketches", required=True)
    p.add_argument("-n", "--new-sketches", required=True)
    p.add_argument("-o", "--output", required=True)

    p = sub.add_parser("kmer-tree", help="k-mer tree from a Newick tree and sketches")
    p.add_argument("-t", "--tree", required=True)
    p.add_argument("--sketches")
    p.add_argument("-o", "--output", required=True)

    p = sub.add_parser("population-tree", help="k-mer tree from a distance matrix (single linkage)")
    p.add_argument("-m", "--matrix-file", required=True)
    p.add_argument("--sketches")
    p.add_argument("-o", "--output", required=True)

    p = sub.add_parser("tree-metrics", help="summary of a k-mer tree")
    p.add_argument("-t", "--kmer-tree", required=True)
    p.add_argument("-o", "--output", required=True)

    for name, about in (("query", "classify sketches against a k-mer tree"),
                        ("query-serially", "classify each of many sketches")):
        p = sub.add_parser(name, help=about)
        if name == "query":
            p.add_argument("-s", "--sketch", help="one sketch folder")
            p.add_argument("--prefix", help="name of the joint query with --sketches")
        p.add_argument("--sketches", required=name == "query-serially", help="file of sketch folders, one per line")
        p.add_argument("-t", "--kmer-tree", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--labels", help="lines of leaf<TAB>label")
        p.add_argument("--normalize", action="store_true", help="scale to the explained share")

    p = sub.add_parser("tree-drawer", help="draw a tree")
    p.add_argument("-t", "--tree", required=True)
    p.add_argument("-o", "--output", required=True, help="SVG file")
    p.add_argument("--colours")
    p.add_argument("--query", help="node report whose weights become branch widths")
    p.add_argument("--ignore-frequency", type=float, default=0.005)
    p.add_argument("--matrix")
    p.add_argument("--equal-dist", action="store_true")
    p.add_argument("--include-id", action="store_true")
    p.add_argument("--font-size", type=int, default=14)
    p.add_argument("--line-width", type=float, default=1.0)
    p.add_argument("--image-height", type=int, default=1000)
    p.add_argument("--image-width", type=int, default=1000)

    p = sub.add_parser("query-drawer", help="draw label reports as stacked bars")
    p.add_argument("-q", "--query-files", required=True, help="file of label reports, one per line")
    p.add_argument("-o", "--output", required=True, help="path prefix of the results")
    p.add_argument("--colours", required=True)
    p.add_argument("--normalize", action="store_true")
    p.add_argument("--min-proportion", type=float, default=0.0)
    p.add_argument("--query-order")
    p.add_argument("--font-size", type=int, default=14)
    p.add_argument("--line-width", type=int, default=2)
    p.add_argument("--image-height", type=int, default=1000)
    p.add_argument("--image-width", type=int, default=1000)

    p = sub.add_parser("prep-data", help="unique ids for FASTA files")
    p.add_argument("-i", "--input-file", required=True, help="file of FASTA paths, one per line")
    p.add_argument("-o", "--output", required=True)
    return top


def run(argv: list[str], spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or build_session()

    def paths(file: str) -> list[str]:
        return [r.path for r in src.read_paths(spark, P.check_file(spark, file)).collect()]

    if a.command == "sketch":
        files = [P.check_file(spark, f) for f in a.seq_files.split(",")]
        W.sketch(spark, [(a.name, f) for f in files], a.output, _sketch_config(a))
    elif a.command == "sketch-serially":
        files, _ = W.manifest(spark, P.check_file(spark, a.libraries))
        W.sketch(spark, files, a.output, _sketch_config(a))
    elif a.command == "sketch-cluster":
        files, skipped = W.manifest(spark, P.check_file(spark, a.libraries), skip_missing=True)
        for sample in skipped:
            print(f"warning: sample {sample} skipped, a file is missing")
        wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(s for s, _ in files)], "sample string")
        libraries = src.read_libraries(spark, a.libraries).join(wanted, "sample", "left_semi")
        template = tables.read_template(spark, P.check_file(spark, a.cluster_config)) if a.cluster_config else \
            spark.createDataFrame([(0, "$COMMAND")], "idx int, line string")
        write_scripts(W.scripts(libraries, template, a.program, a.output, _sketch_config(a)), a.output)
    elif a.command == "distance":
        W.distance(spark, paths(a.sketches), a.output, a.jd)
    elif a.command == "update":
        W.update(spark, a.matrix, paths(a.existing_sketches), paths(a.new_sketches), a.output)
    elif a.command == "kmer-tree":
        W.build_tree(spark, P.check_file(spark, a.tree), paths(a.sketches) if a.sketches else None, a.output)
    elif a.command == "population-tree":
        W.population_tree(spark, a.matrix_file, paths(a.sketches) if a.sketches else None, a.output)
    elif a.command == "tree-metrics":
        W.tree_metrics(spark, P.check_directory(spark, a.kmer_tree), a.output)
    elif a.command == "query":
        require((a.sketch is None) != (a.sketches is None), "give either --sketch or --sketches")
        require(a.sketches is None or a.prefix is not None, "a joint query needs --prefix")
        given = [a.sketch] if a.sketch else paths(a.sketches)
        W.query(spark, P.check_directory(spark, a.kmer_tree), given, a.output, a.labels, QueryConfig(a.normalize),
                joint_name=a.prefix)
    elif a.command == "query-serially":
        W.query(spark, P.check_directory(spark, a.kmer_tree), paths(a.sketches), a.output, a.labels, QueryConfig(a.normalize))
    elif a.command == "tree-drawer":
        config = TreeDrawing(a.image_height, a.image_width, a.font_size, a.line_width, a.ignore_frequency,
                             a.equal_dist, a.include_id)
        W.draw_tree(spark, P.check_directory(spark, a.tree), a.output, config, a.colours, a.query, a.matrix)
    elif a.command == "query-drawer":
        config = LabelDrawing(a.image_height, a.image_width, a.font_size, a.line_width, a.normalize, a.min_proportion)
        W.draw_labels(spark, paths(a.query_files), P.check_file(spark, a.colours), a.output, config, a.query_order)
    elif a.command == "prep-data":
        prepared = src.prepared_ids(spark, paths(a.input_file))
        prepared.orderBy("idx").select("id", "path").write.csv(a.output, sep="\t")
