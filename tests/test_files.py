import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kmergrid import validate as V
from kmergrid.functions import text as X
from kmergrid.plans.cli import run
from kmergrid.sources import sequences as src
from kmergrid.sources import tables
from test_distance import brute
from test_sequence import brute as kmer_brute


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def text_of(folder):
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(os.path.join(folder, f)).read() for f in parts)


def test_fasta_records(spark, tmp_path):
    a = write(tmp_path / "a.fa", ">a x > y\nAC\nGT\n>b\nGG\n>empty\n>c\r\nTT\r\nA\n>last")
    assert rows(src.read_fasta(spark, [a]).select("seq")) == [("ACGT",), ("GG",), ("TTA",)]
    bad = write(tmp_path / "bad.fa", "ACGT\n>a\nAC\n")
    with pytest.raises(ValueError):
        src.read_sequences(spark, [a, bad])


def test_fastq_across_splits(spark, tmp_path):
    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGT", k=rng.randrange(1, 60))) for _ in range(400)]
    body = "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs))
    plain = write(tmp_path / "r.fastq", body)
    with gzip.open(tmp_path / "r.fq.gz", "wt") as out:
        out.write(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = src.read_sequences(spark, [plain, str(tmp_path / "r.fq.gz")])
        assert sorted(r.seq for r in got.select("seq").collect()) == sorted(seqs * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    with pytest.raises(ValueError):
        src.read_fastq(spark, [write(tmp_path / "cut.fastq", "@a\nAC\n+\n")])


@pytest.mark.parametrize("name,kind", [("x.fa", "fasta"), ("xfasta", "fasta"), ("x.fna", "fasta"), ("x.fq", "fastq"),
                                       ("x.fastq.gz", "fastq.gz"), ("x.fq.gz", "fastq.gz")])
def test_type_by_name(name, kind):
    assert X.type_of(name) == kind


def test_unknown_types():
    for name in ("x.fa.gz", "x.txt"):
        with pytest.raises(ValueError):
            X.type_of(name)


def test_reads_pooled_over_files(spark, tmp_path):
    """A sample of reads in two files, one gzipped, sized by file length only."""
    rng = random.Random(4)
    genome = "".join(rng.choices("ACGT", k=300))
    reads = [genome[i:i + 50] for i in range(0, 250, 5)]
    body = ["".join(f"@r\n{s}\n+\n{s}\n" for s in part) for part in (reads[:25], reads[25:])]
    one = write(tmp_path / "one.fq", body[0])
    with gzip.open(tmp_path / "two.fastq.gz", "wt") as out:
        out.write(body[1])
    run(["sketch", "-s", f"{one},{tmp_path / 'two.fastq.gz'}", "--name", "R", "-o", str(tmp_path / "r"),
         "--kmer-size", "13", "--sketch-size", "40", "--min-cov", "3", "--track-cov"], spark)
    counts = {}
    for s in reads:
        for _, h in kmer_brute(s, 13):
            counts[h] = counts.get(h, 0) + 1
    want = sorted((h, n) for h, n in counts.items() if n >= 3)[:40]
    sketch, meta = tables.read_sketches(spark, [str(tmp_path / "r")])
    assert rows(sketch.select("hash", "coverage")) == want
    assert meta.first().genome_size == int(2**32 * 40 / (want[-1][0] + 2**31 + 1))


def test_manifests_and_small_tables(spark, tmp_path):
    libs = src.read_libraries(spark, write(tmp_path / "libs.tsv", "s1\ta.fa\tb.fa\ns2\tc.fq\n"))
    assert rows(src.library_files(libs)) == [("s1", "a.fa"), ("s1", "b.fa"), ("s2", "c.fq")]
    labels = tables.read_labels(spark, write(tmp_path / "l.tsv", "A\tx\nB\ty\nA\tz\n"))
    assert rows(labels) == [("A", "z"), ("B", "y")]
    colours = tables.read_colours(spark, write(tmp_path / "c.tsv", "y\t370\t0.5\t2\nx\t10\t1\t0\n"))
    assert [(r.label, r.idx, r.colour.h, r.colour.l) for r in colours.orderBy("idx").collect()] == [
        ("y", 0, 10.0, 1.0), ("x", 1, 10.0, 0.0)]
    assert tables.read_colours(spark, None).count() == 0
    order = tables.read_order(spark, write(tmp_path / "o.txt", "q2\nq1\n"))
    assert rows(order) == [("q1", 1), ("q2", 0)]
    skipped = tables.numbered_lines(spark, write(tmp_path / "h.txt", "#a\n#b\nx\n#kept\n"), comment="#")
    assert [r.value for r in skipped.orderBy("idx").collect()] == ["x", "#kept"]
    matrix, names = tables.read_matrix(spark, write(tmp_path / "m.matrix", "$\tB\tA\nB\t0.0\t0.5\nA\t0.5\t0.0\n"))
    assert names == ["B", "A"] and rows(matrix) == [("A", "B", 0.5)]
    with pytest.raises(ValueError):
        tables.read_matrix(spark, write(tmp_path / "bad.matrix", "$\tB\tA\nB\t0.0\nA\t0.5\t0.0\n"))


def test_prepared_ids(spark, tmp_path):
    a = write(tmp_path / "a.fa", ">chr1 first\nAC\n>chr2\nGG\n")
    b = write(tmp_path / "b.fa", ">chr1\nAC\n")
    got = src.prepared_ids(spark, [a, b]).orderBy("idx").select("id", "path").collect()
    assert [tuple(r) for r in got] == [("chr1+0", a), ("chr1+1", b)]


def test_validation(spark):
    meta = "sample string, kmer_length int, genome_size bigint, sketch_size int"
    ok = spark.createDataFrame([("a", 21, 1, 5), ("b", 21, 1, 4)], meta)
    assert V.sketch_set(ok) == (21, 4, 2)
    for bad in ([("a", 21, 1, 5), ("a", 21, 1, 5)], [("a", 21, 1, 5), ("b", 19, 1, 5)], []):
        with pytest.raises(ValueError):
            V.sketch_set(spark.createDataFrame(bad, meta))
    for other in ([("b", 21, 1, 4)], [("c", 19, 1, 4)], [("c", 21, 1, 3)]):
        with pytest.raises(ValueError):
            V.update_inputs(ok, spark.createDataFrame(other, meta))
    props = spark.createDataFrame([("q", 0.5), ("q", 0.4)], "name string, weight double")
    with pytest.raises(ValueError):
        V.proportions_sum_to_one(props)


def test_command_line_end_to_end(spark, tmp_path):
    rng = random.Random(9)
    base = "".join(rng.choices("ACGT", k=600))
    genomes = {"A": base, "B": base[:400] + "".join(rng.choices("ACGT", k=200)),
               "C": base[:100] + "".join(rng.choices("ACGT", k=500))}
    k, s = 15, 60
    manifest = ""
    for name, g in genomes.items():
        manifest += f"{name}\t{write(tmp_path / (name + '.fa'), f'>{name}{chr(10)}{g[:300]}{chr(10)}{g[300:]}{chr(10)}')}\n"
    libs = write(tmp_path / "libs.tsv", manifest)
    options = ["--kmer-size", str(k), "--sketch-size", str(s), "--assembly"]
    run(["sketch-serially", "-l", libs, "-o", str(tmp_path / "all"), "--track-cov", *options], spark)
    sketch, meta = tables.read_sketches(spark, [str(tmp_path / "all")])
    hashes = {n: set(sorted({h for _, h in kmer_brute(g, k)})[:s]) for n, g in genomes.items()}
    for n in genomes:
        assert {r.hash for r in sketch.where(F.col("sample") == n).collect()} == hashes[n]
    assert rows(meta) == [(n, k, 600, s) for n in "ABC"]
    assert text_of(tmp_path / "all" / "coverages").startswith("A\t2\t")

    # the same sample on its own
    run(["sketch", "-s", str(tmp_path / "C.fa"), "--name", "C2", "-o", str(tmp_path / "c2"), *options], spark)
    paths = write(tmp_path / "all.txt", f"{tmp_path / 'all'}\n")
    new = write(tmp_path / "new.txt", f"{tmp_path / 'c2'}\n")

    run(["distance", "--sketches", paths, "-o", str(tmp_path / "d.matrix"), "--jd"], spark)
    shared, _ = brute(hashes["A"], hashes["B"])
    lines = text_of(tmp_path / "d.matrix").splitlines()
    assert lines[0] == "$\tA\tB\tC" and [x.split("\t")[0] for x in lines[1:]] == ["A", "B", "C"]
    assert lines[1].split("\t")[1] == "0.0"
    assert float(lines[1].split("\t")[2]) == pytest.approx(1 - shared / s)

    run(["update", "-m", str(tmp_path / "d.matrix"), "-e", paths, "-n", new, "-o", str(tmp_path / "u.matrix")], spark)
    grown = [x.split("\t") for x in text_of(tmp_path / "u.matrix").splitlines()]
    assert grown[0] == ["$", "A", "B", "C", "C2"]
    assert grown[1][2] == lines[1].split("\t")[2]          # taken over
    assert float(grown[3][4]) == 0.0                       # C and C2 are the same genome

    nwk = write(tmp_path / "t.nwk", "((A:0.1,B:0.2):0.05,C:0.3);\n")
    run(["kmer-tree", "-t", nwk, "--sketches", paths, "-o", str(tmp_path / "tree")], spark)
    tree, lca, info = tables.read_kmer_tree(spark, str(tmp_path / "tree"))
    assert rows(info) == [(s, k)] and lca.count() == len(set().union(*hashes.values()))
    run(["tree-metrics", "-t", str(tmp_path / "tree"), "-o", str(tmp_path / "metrics")], spark)
    run(["population-tree", "-m", str(tmp_path / "d.matrix"), "--sketches", paths, "-o", str(tmp_path / "ptree")], spark)
    assert tables.read_kmer_tree(spark, str(tmp_path / "ptree"))[0].count() == 5

    labels = write(tmp_path / "labels.tsv", "A\tx\nB\tx\nC\ty\n")
    run(["query-serially", "--sketches", new, "-t", str(tmp_path / "tree"), "-o", str(tmp_path / "q"), "--labels", labels], spark)
    report = spark.read.csv(str(tmp_path / "q" / "nodes"), sep="\t", header=True)
    assert report.count() == 5 and {r.sample for r in report.collect()} == {"C2"}
    scores = {r.Label: float(r.Weight) for r in spark.read.csv(str(tmp_path / "q" / "labels"), sep="\t", header=True).collect()}
    assert set(scores) == {"x", "y", "Unique"} and sum(scores.values()) == pytest.approx(1)
    run(["query", "--sketches", paths, "--prefix", "joint", "-t", str(tmp_path / "tree"), "-o", str(tmp_path / "j"),
         "--labels", labels, "--normalize"], spark)
    joint = spark.read.csv(str(tmp_path / "j" / "labels"), sep="\t", header=True).collect()
    assert {r.Label for r in joint} == {"x", "y"} and sum(float(r.Weight) for r in joint) == pytest.approx(1)

    colours = write(tmp_path / "colours.tsv", "x\t10\t1\t0.5\ny\t200\t1\t0.5\n")
    leaf_colours = write(tmp_path / "leaf.tsv", "A\t10\t1\t0.5\nB\t10\t1\t0.5\nC\t200\t1\t0.5\n")
    run(["tree-drawer", "-t", str(tmp_path / "tree"), "-o", str(tmp_path / "t.svg"), "--colours", leaf_colours,
         "--query", str(tmp_path / "q" / "nodes" / "sample=C2"), "--matrix", str(tmp_path / "d.matrix"), "--include-id"], spark)
    svg = (tmp_path / "t.svg").read_text()
    assert svg.count("<rect") == 9 and ">C</text>" in svg and "hsl(200.0,100.0%,50.0%)" in svg
    files = write(tmp_path / "reports.txt", f"{tmp_path / 'q' / 'labels' / 'sample=C2'}\n")
    run(["query-drawer", "-q", files, "-o", str(tmp_path / "bars"), "--colours", colours], spark)
    assert (tmp_path / "bars.svg").read_text().count("<rect") >= 2
    head = text_of(tmp_path / "bars.query.matrix").splitlines()
    assert head[0] == "name\tx\ty\tUnique" and head[1].startswith("C2\t")
    short = write(tmp_path / "order.txt", "other\n")
    with pytest.raises(ValueError):
        run(["query-drawer", "-q", files, "-o", str(tmp_path / "bars2"), "--colours", colours, "--query-order", short], spark)
    full = write(tmp_path / "order2.txt", "other\nC2\n")
    run(["query-drawer", "-q", files, "-o", str(tmp_path / "bars3"), "--colours", colours, "--normalize",
         "--query-order", full], spark)
    assert text_of(tmp_path / "bars3.query.matrix").splitlines()[0] == "name\tx\ty"
    run(["sketch-cluster", "-l", libs, "-o", str(tmp_path / "scripts"), "--cluster-config",
         write(tmp_path / "tpl", "#SBATCH $STDOUT\n$COMMAND\n")], spark)
    script = text_of(tmp_path / "scripts" / "sample=A").splitlines()
    assert script[0].endswith("/A/A.out") and "--name A" in script[1]
    run(["prep-data", "-i", write(tmp_path / "fa.txt", f"{tmp_path / 'A.fa'}\n"), "-o", str(tmp_path / "prep")], spark)
    assert text_of(tmp_path / "prep") == f"A+0\t{tmp_path / 'A.fa'}\n"
