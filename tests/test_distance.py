import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kmergrid.config import DistanceConfig
from kmergrid.operators import distance as D
from kmergrid.operators import linkage

A, B, C = {1, 2, 3, 4}, {1, 2, 5, 6}, {1, 3, 7, 8}


def table(spark, sketches):
    return spark.createDataFrame([(n, h) for n, s in sketches.items() for h in s], "sample string, hash int")


def brute(x, y):
    s = min(len(x), len(y))
    union = sorted(x | y)[:s]
    return sum(h in x and h in y for h in union), s


def test_worked_example(spark):
    got = {(r.a, r.b): r for r in D.pairwise(table(spark, {"A": A, "B": B, "C": C}), DistanceConfig(21)).collect()}
    assert [(k, r.shared, r.jaccard) for k, r in sorted(got.items())] == [
        (("A", "B"), 2, 0.5), (("A", "C"), 2, 0.5), (("B", "C"), 1, 0.25)]
    assert got["A", "B"].distance == pytest.approx(0.019307862290864973)
    assert got["B", "C"].distance == pytest.approx(0.043632891994007376)


def test_identical_and_disjoint(spark):
    d = D.pairwise(table(spark, {"A": A, "A2": A, "Z": {-9, 90}}), DistanceConfig(21))
    got = {(r.a, r.b): r.distance for r in d.collect()}
    assert math.copysign(1, got["A", "A2"]) == 1 and got["A", "A2"] == 0.0
    assert got["A", "Z"] == math.inf


def test_union_of_one_pair(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 5, 6]), ([1, 9], [2, 3, 9])], "x array<int>, y array<int>")
    got = df.select(D.bottom_union(F.col("x"), F.col("y")), D.shared_in_union(F.col("x"), F.col("y"))).collect()
    assert [(list(r[0]), r[1]) for r in got] == [([1, 2, 3, 4], 2), ([1, 2], 0)]


@pytest.mark.parametrize("blocks,thin_from", [(1, 99), (7, 99), (3, 1)])
def test_grid_matches_brute_force(spark, monkeypatch, blocks, thin_from):
    monkeypatch.setattr(D, "THIN_FROM", thin_from)
    rng = random.Random(blocks)
    pool = [rng.randrange(-2**31, 2**31) for _ in range(60)]
    sketches = {f"s{i}": set(rng.sample(pool, rng.randrange(1, 40))) for i in range(25)}
    sketches["private"] = {7, 8, 9}
    sketches["s0"] |= {rng.randrange(-2**31, 2**31) for _ in range(10)}
    got = rows(D.shared_counts(D.hash_arrays(table(spark, sketches)), blocks))
    want = sorted((a, b, *brute(sketches[a], sketches[b])) for a in sketches for b in sketches if a < b)
    assert got == want


@pytest.mark.parametrize("blocks,thin_from", [(1, 99), (4, 2)])
def test_update_computes_only_new_pairs(spark, monkeypatch, blocks, thin_from):
    monkeypatch.setattr(D, "THIN_FROM", thin_from)
    rng = random.Random(3)
    sketches = {f"s{i}": set(rng.sample(range(50), 20)) for i in range(12)}
    old = {f"s{i}" for i in range(7)}
    arrays = D.hash_arrays(table(spark, sketches)).withColumn("old", F.col("sample").isin(*old))
    got = rows(D.shared_counts(arrays, blocks, new_only=True))
    want = sorted((a, b, *brute(sketches[a], sketches[b])) for a in sketches for b in sketches
                  if a < b and not (a in old and b in old))
    assert got == want


def test_update_keeps_old_values(spark):
    known = spark.createDataFrame([("A", "B", 0.123)], "a string, b string, distance double")
    got = rows(D.update(known, table(spark, {"A": A, "B": B}), table(spark, {"C": C}), DistanceConfig(21)))
    assert [(a, b) for a, b, _ in got] == [("A", "B"), ("A", "C"), ("B", "C")]
    assert got[0][2] == 0.123 and got[1][2] == pytest.approx(0.019307862290864973)


def test_matrix_shapes(spark):
    d = D.pairwise(table(spark, {"A": A, "B": B, "C": C}), DistanceConfig(21, jaccard_distance=True))
    names = spark.createDataFrame([(0, "C"), (1, "A"), (2, "B")], "idx int, name string")
    got = {r.name: (r.idx, list(r.row)) for r in D.matrix_rows(d, names).collect()}
    assert got == {"C": (0, [0.0, 0.5, 0.75]), "A": (1, [0.5, 0.0, 0.5]), "B": (2, [0.75, 0.5, 0.0])}
    wide = D.matrix_wide(d, ["A", "B", "C"])
    assert rows(wide) == [("A", 0.0, 0.5, 0.5), ("B", 0.5, 0.0, 0.75), ("C", 0.5, 0.75, 0.0)]
    assert rows(D.unpivot(wide)) == [("A", "B", 0.5), ("A", "C", 0.5), ("B", "C", 0.75)]


def test_spanning_tree_matches_kruskal(spark):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(12)]
    edges = [(a, b, rng.choice([0.1, 0.2, 0.3, 0.4, math.inf])) for a in names for b in names if a < b]
    comp = {n: n for n in names}
    want = []
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if comp[a] != comp[b]:
            want.append((a, b, d))
            old = comp[b]
            comp = {n: comp[a] if c == old else c for n, c in comp.items()}
    df = spark.createDataFrame(edges, "a string, b string, distance double")
    assert rows(linkage.spanning_tree(df)) == sorted(want)


def test_dendrogram_text():
    text = linkage.to_newick([("A", "B", 0.1), ("B", "C", 0.4)])
    assert text == "(C:0.4,(B:0.1,A:0.1):0.4);"


def test_grid_shuffles_no_block_to_its_cells(spark):
    # every sketch went to one cell per block, so the disk took samples times blocks
    plan = D.shared_counts(D.hash_arrays(table(spark, {"A": A, "B": B, "C": C})), 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("dense,matches", [(4, 1 << 21), (1, 5), (1000, 1 << 21)])
def test_cell_counts_are_the_same_however_they_are_found(monkeypatch, dense, matches):
    monkeypatch.setattr(D, "DENSE", dense)
    monkeypatch.setattr(D, "MATCHES", matches)
    rng = random.Random(dense)
    pool = [rng.randrange(-2**31, 2**31) for _ in range(40)]
    sets = [{f"{side}{i:02d}": set(rng.sample(pool, rng.randrange(0, 30))) for i in range(12)} for side in "xy"]
    sets[1] |= {f"y{i}": set(pool[:30]) for i in range(12, 18)}

    def block(sketches):
        packed = D._pack(pa.table({"sample": list(sketches), "size": pa.array([len(h) for h in sketches.values()], pa.int32()),
                                   "hashes": pa.array([sorted(h) for h in sketches.values()], pa.list_(pa.int32())),
                                   "old": [False] * len(sketches), "block": pa.array([0] * len(sketches), pa.int32())}))
        return D._unpack(packed.to_batches()[0], 0)

    x, y = map(block, sets)
    for left, right, same in ((x, y, False), (y, y, True)):
        got = [tuple(r.values()) for part in D._cell_pairs(left, right, same) for r in part.to_pylist()]
        names = {**sets[0], **sets[1]}
        want = sorted((a, b, *brute(names[a], names[b])) for a in left.names.to_pylist() for b in right.names.to_pylist() if a < b)
        assert sorted(got) == want
