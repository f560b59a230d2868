
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kmergrid import validate as V
from kmergrid.config import DistanceConfig, SketchConfig
from kmergrid.operators import classify as C
from kmergrid.operators import distance as D
from kmergrid.operators import sketch as K
from kmergrid.plans import workflows as W
from kmergrid.plans.cli import run
from kmergrid.sources import paths as P
from kmergrid.sources import sequences as src
from kmergrid.sources import tables

RECORD = ">a\nACGTTGCAACGTACGTTAGC\n"


@pytest.fixture
def folder(tmp_path, monkeypatch):
    (tmp_path / "in put").mkdir()
    (tmp_path / "in put" / "a.fa").write_text(RECORD)
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_every_spelling_finds_its_records(spark, folder):
    spellings = ["in put/a.fa", "./in put/a.fa", f"{folder}/./in put/a.fa", f"{folder}//in put//a.fa", f"file:{folder}/in put/a.fa",
                 f"file://{folder}/in put/../in put/a.fa"]
    for path in spellings:
        assert P.file_key(spark, path) == P.file_key(spark, spellings[2])
        assert src.sample_sequences(spark, [("s", path)]).count() == 1
        assert src.estimated_sizes(spark, [("s", path)]).first().n_bases == len(RECORD)
        assert [r.id for r in src.prepared_ids(spark, [path]).collect()] == ["a+0"]
    with pytest.raises(ValueError):
        src.sample_sequences(spark, [("s", "in put/b.fa")])
    with pytest.raises(ValueError):
        P.check_directory(spark, "in put/a.fa")


def test_sketch_from_another_directory(spark, folder):
    (folder / "list.tsv").write_text("s\tin put/a.fa\n")
    run(["sketch-serially", "-l", "list.tsv", "-o", str(folder / "out"), "--assembly", "--kmer-size", "9"], spark)
    sketch, meta = tables.read_sketches(spark, [str(folder / "out")])
    assert meta.count() == 1 and sketch.count() > 0


@pytest.fixture
def short_sample(spark):
    records = spark.createDataFrame([("a", "ACGTTGCAACGTACGTTAGC"), ("b", "ACGTTGCAACGTACGTTAGG"), ("c", "ACG"), ("d", "ACGTTGCAACGTACGTAAAA")], "sample string, seq string")
    config = SketchConfig(9, 50, assembly=True)
    sketch = K.build_sketches(records, config)
    return sketch, K.sketch_meta(sketch, K.sample_sizes(records), config)


def test_matrix_with_an_empty_sketch(spark, short_sample, tmp_path):
    sketch, meta = short_sample
    pairs = D.pairwise(sketch, DistanceConfig(9), names=meta.select("sample"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(x, y) for x in "abcd" for y in "abcd" if x < y}
    assert {r.distance for r in pairs.where("a = 'c' or b = 'c'").collect()} == {float("inf")}
    flat = D.pairwise(sketch, DistanceConfig(9, True), names=meta.select("sample"))
    assert {r.distance for r in flat.where("a = 'c' or b = 'c'").collect()} == {1.0}
    names = W._ordered_names(meta)
    W.out.write_matrix(D.matrix_rows(pairs, names), names, f"file://{tmp_path}/m")
    read, order = tables.read_matrix(spark, f"file://{tmp_path}/m")
    assert order == list("abcd") and rows(read) == rows(pairs.select("a", "b", "distance"))
    with pytest.raises(Exception, match="without a value"):
        D.matrix_rows(pairs.where("a <> 'a' or b <> 'd'"), names).collect()


def test_smallest_sketch_and_reports(spark, short_sample):
    sketch, meta = short_sample
    k, smallest, count = V.sketch_set(meta)
    assert (k, count) == (9, 4) and smallest > 0
    lca = sketch.where("sample = 'a'").select("hash", F.lit(0).alias("node_id"))
    found = {r["sample"]: tuple(r)[1:] for r in C.explained(C.hits(sketch.select("sample", "hash"), lca, meta.select("sample"))).collect()}
    assert found["c"] == (0, 0, 0.0) and found["a"][2] == 1.0
    with pytest.raises(ValueError):
        V.query_inputs(meta, 0, 9)
    with pytest.raises(ValueError):
        V.query_inputs(meta, 5, 11)
    V.same_names(list("abcd"), meta)
    with pytest.raises(ValueError):
        V.same_names(list("abce"), meta)
