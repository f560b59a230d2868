import re
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kmergrid.operators import classify as C
from kmergrid.operators import tree as T
from kmergrid.sources.newick import read_tree, tree_rows

TEXT = "((A:0.1,B:0.2):0.05,C:0.3);"
SKETCHES = {"A": {1, 2, 3, 4}, "B": {1, 2, 5, 6}, "C": {1, 3, 7, 8}}


@pytest.fixture(scope="module")
def tree(spark):
    return read_tree(spark, TEXT).cache()


@pytest.fixture(scope="module")
def lca(spark, tree):
    return C.kmer_lca(sketch(spark, SKETCHES), tree).cache()


def sketch(spark, sketches):
    return spark.createDataFrame([(n, h) for n, s in sketches.items() for h in s], "sample string, hash int")


def random_newick(rng, names):
    parts = [f"{n}:{rng.randrange(1, 9) / 10}" for n in names]
    while len(parts) > 2:
        a = parts.pop(rng.randrange(len(parts)))
        b = parts.pop(rng.randrange(len(parts)))
        parts.append(f"({a},{b}):{rng.randrange(1, 9) / 10}")
    return f"({parts[0]},{parts[1]});"


def test_ids_and_intervals(tree):
    got = rows(tree.select("node_id", F.coalesce("name", F.lit("")), F.coalesce("parent_id", F.lit(-1)), "lo", "hi", "depth", "dist"))
    assert got == [(0, "C", 1, 0, 0, 1, 0.3), (1, "", -1, 0, 4, 0, 0.0), (2, "B", 3, 2, 2, 2, 0.2),
                   (3, "", 1, 2, 4, 1, 0.05), (4, "A", 3, 4, 4, 2, 0.1)]
    assert rows(tree.where("not is_leaf").select("node_id", "left_id", "right_id")) == [(1, 0, 3), (3, 2, 4)]


@pytest.mark.parametrize("bad", [
    "(A:1,B:1,C:1);", "(A:1,B);", "(A:1,B:1)root;", "((A:1,B:1)x:1,C:1);", "(A:1,A:1);", "A:1;", "((A:1,B:1):1,C:1;", "(A:1);"])
def test_newick_errors(bad):
    with pytest.raises(ValueError):
        tree_rows(bad)


def test_negative_lengths_and_deep_trees():
    assert sorted(r[6] for r in tree_rows("(A:-0.5,B:1e-3);")) == [0.0, 0.001, 0.5]
    deep = "(" * 5000 + "x0:1" + "".join(f",x{i}:1):1" for i in range(1, 5000)) + ",last:1);"
    rows_ = tree_rows(deep)
    assert len(rows_) == 2 * 5001 - 1 and max(r[7] for r in rows_) == 5000


def test_lca_of_example(lca):
    assert rows(lca.select("hash", "node_id")) == [(1, 1), (2, 3), (3, 1), (4, 4), (5, 2), (6, 2), (7, 0), (8, 0)]


def test_metrics_of_example(tree, lca):
    assert rows(C.tree_metrics(lca, tree)) == [
        (0, "C", 1, 1, 2), (1, "", 4, 3, 8), (2, "B", 1, 1, 2), (3, "", 2, 2, 4), (4, "A", 1, 1, 1)]


def test_coordinates_of_example(tree):
    got = {r.node_id: (round(r.x, 9), round(r.y, 9)) for r in T.coordinates(tree, 3, 0.3, 3).collect()}
    assert got == {0: (0.3, 0.0), 1: (0.0, 0.75), 2: (0.25, 1.0), 3: (0.05, 1.5), 4: (0.15, 2.0)}


def test_query_of_example(spark, tree, lca):
    hit = C.hits(C.trim(sketch(spark, {"Q": {1, 2, 4, 9}}), 4), lca)
    assert rows(C.node_counts(hit)) == [("Q", 1, 1), ("Q", 3, 1), ("Q", 4, 1)]
    assert rows(C.explained(hit)) == [("Q", 4, 3, 0.75)]
    got = rows(C.node_report(hit, tree).select("id", "name", "weight"))
    assert got == [(0, "C", 0.0), (1, "", 0.75), (2, "B", 0.0), (3, "", 0.5), (4, "A", 0.25)]


def test_labels_of_example(spark, tree, lca):
    labels = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "leaf string, label string")
    weights = C.node_label_weights(tree, labels)
    hit = C.hits(sketch(spark, {"Q": {1, 2, 4, 9}, "R": {99}}), lca)
    got = {(r.name, r.label): round(r.weight, 7) for r in C.label_scores(hit, weights, C.root_of(tree)).collect()}
    assert got == {("Q", "x"): 0.6666667, ("Q", "y"): 0.0833333, ("Q", "Unique"): 0.25,
                   ("R", "x"): 0.0, ("R", "y"): 0.0, ("R", "Unique"): 1.0}
    scaled = {(r.name, r.label): round(r.weight, 7)
              for r in C.label_scores(hit, weights, C.root_of(tree), normalize=True).collect()}
    assert scaled == {("Q", "x"): 0.8888889, ("Q", "y"): 0.1111111, ("R", "x"): 0.0, ("R", "y"): 0.0}


def test_pooled_query_counts_each_sketch(spark, lca):
    hit = C.hits(C.pooled(sketch(spark, {"Q": {1, 9}, "R": {1, 4}}), "all"), lca)
    assert rows(C.node_counts(hit)) == [("all", 1, 2), ("all", 4, 1)]
    assert rows(C.explained(hit)) == [("all", 4, 3, 0.75)]


@pytest.mark.parametrize("seed,n", [(1, 2), (2, 9), (3, 24)])
def test_random_trees_against_recursion(spark, monkeypatch, seed, n):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(n)]
    text = random_newick(rng, names)
    nodes = {r[0]: r for r in tree_rows(text)}
    tree = read_tree(spark, text)
    kids = {i: (r[2], r[3]) for i, r in nodes.items() if r[2] is not None}

    def below(i):
        return {i} if i not in kids else {i} | below(kids[i][0]) | below(kids[i][1])

    root = next(i for i, r in nodes.items() if r[1] is None)

    def post(i):
        return [] if i not in kids else post(kids[i][0]) + post(kids[i][1]) + [i]

    def lowest(ids):
        return min((i for i in nodes if ids <= below(i)), key=lambda i: len(below(i)))

    sketches = {nm: set(rng.sample(range(40), rng.randrange(0, 15))) for nm in names[:-1]}
    leaf_id = {r[5]: i for i, r in nodes.items() if r[4]}
    table = sketch(spark, sketches)
    want_lca = {h: lowest({leaf_id[nm] for nm, s in sketches.items() if h in s})
                for h in set().union(*sketches.values())} if sketches else {}
    assert dict(rows(C.kmer_lca(table, tree))) == want_lca
    big = C.T.lowest_common_ancestor  # the shuffled variant gives the same answer
    spans = spark.createDataFrame([(a, b) for a in nodes for b in nodes if a <= b], "lo_id int, hi_id int")
    got = {(a, b): c for a, b, c in rows(big(spans, tree, small=False))}
    assert got == {(a, b): lowest(set(range(a, b + 1))) for a in nodes for b in nodes if a <= b}
    assert [i for _, i in rows(T.post_order(tree))] == post(root)
    assert rows(T.descendants(tree)) == sorted(
        (i, d) for i in nodes for d in below(i) if d != i or i not in kids)
    counts = {("q", i): rng.randrange(0, 5) for i in nodes} | {("r", 0): 3}
    cdf = spark.createDataFrame([(s, i, c) for (s, i), c in counts.items()], "sample string, node_id int, cnt int")
    groups = spark.createDataFrame([("q",), ("r",), ("none",)], "sample string")
    want = sorted((s, i, float(sum(counts.get((s, d), 0) for d in below(i)))) for s in ("q", "r", "none") for i in nodes)
    assert rows(T.cumulative(cdf, tree, groups)) == want
    # the sums without zeros, by broadcast and by shuffle, and the report that lists the zeros again
    sparse = [w for w in want if w[2] > 0]
    assert [r for r in rows(T.sums_below(cdf, tree)) if r[2] > 0] == sparse
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert [r for r in rows(T.sums_below(cdf, tree)) if r[2] > 0] == sparse
    monkeypatch.setattr(C, "REPORT_BLOCK", 2)
    hit = cdf.selectExpr("sample", "node_id", "cast(cnt as bigint) cnt").unionByName(
        spark.createDataFrame([("none", None, 0), ("q", None, 4)], "sample string, node_id int, cnt bigint"))
    whole = {s: sum(c for (x, _), c in counts.items() if x == s) + 4 * (s == "q") for s in ("q", "r", "none")}
    share = sorted((s, i, t / whole[s] if whole[s] else 0.0) for s, i, t in want)
    assert rows(C.node_report(hit, tree).select("sample", "id", "weight")) == share
    assert rows(C.largest_shares(hit, tree)) == sorted((i, max(w for _, j, w in share if j == i)) for i in nodes)
    assert C.largest_shares(hit.limit(0), tree).count() == 0


def test_report_shuffles_nodes_not_rows(spark, tree, lca):
    """Queries times nodes rows must not be made before the last shuffle."""
    hit = C.hits(sketch(spark, {"Q": {1, 2, 4, 9}, "R": {1}}), lca)
    plan = C.node_report(hit, tree)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("explode(__samples") < plan.index("Exchange")


def test_missing_sketch_keeps_leaf(spark, tree):
    meta = spark.createDataFrame([("A", 100), ("B", 300)], "sample string, genome_size bigint")
    sized = C.with_genome_sizes(tree, meta)
    assert rows(sized.select("node_id", "genome_size")) == [(0, 0), (1, 0), (2, 300), (3, 0), (4, 100)]
    largest = T.largest_genome(tree, meta.withColumnRenamed("sample", "name"))
    assert rows(largest) == [(0, 0), (1, 300), (2, 300), (3, 300), (4, 100)]


def test_uniform_colour(spark, tree):
    colours = spark.createDataFrame([("A", "red"), ("B", "red"), ("C", "blue")], "name string, colour string")
    assert rows(T.uniform_colour(tree, colours)) == [(0, "blue"), (2, "red"), (3, "red"), (4, "red")]


@pytest.mark.parametrize("seed,n", [(1, 2), (2, 9), (3, 23)])
def test_ranges_over_several_spans(spark, monkeypatch, seed, n):
    monkeypatch.setattr(T, "SPAN", 4)
    monkeypatch.setattr(T, "BLOCK", 2)
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(n)]
    text = random_newick(rng, names)
    nodes = {r[0]: r for r in tree_rows(text)}
    tree = read_tree(spark, text)
    span = {i: range(r.lo, r.hi + 1) for i, r in ((r.node_id, r) for r in tree.collect())}
    counts = {(s, i): rng.randrange(1, 9) for s in "ab" for i in nodes if rng.random() < 0.6}
    cdf = spark.createDataFrame([(s, i, c) for (s, i), c in counts.items()], "sample string, node_id int, cnt int")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    assert rows(T.cumulative(cdf, tree, groups)) == sorted(
        (s, i, float(sum(counts.get((s, d), 0) for d in span[i]))) for s in "abc" for i in nodes)
    sizes = {nm: rng.randrange(1, 99) for nm in names if rng.random() < 0.8}
    table = spark.createDataFrame(list(sizes.items()) or [("x", 0)], "name string, genome_size bigint")
    leaf = {i: r[5] for i, r in nodes.items() if r[4]}
    assert rows(T.largest_genome(tree, table)) == sorted(
        (i, max(sizes.get(leaf[d], 0) for d in span[i] if d in leaf)) for i in nodes)
    colour = {nm: rng.choice(["red", "blue"]) for nm in names}
    found = rows(T.uniform_colour(tree, spark.createDataFrame(list(colour.items()), "name string, colour string")))
    below = {i: {colour[leaf[d]] for d in span[i] if d in leaf} for i in nodes}
    assert found == sorted((i, c) for i, (c, *more) in ((i, tuple(v)) for i, v in below.items()) if not more)
    above = {i: [d for d in nodes if i in span[d]] for i in nodes}
    dist = {r.node_id: r.dist for r in tree.collect()}
    assert dict(rows(T.root_distance(tree))) == pytest.approx({i: sum(dist[d] for d in above[i]) for i in nodes})


def test_running_totals_are_cut_inside_a_group(spark):
    points = spark.createDataFrame([("a", 1, 1.0)], "sample string, pos int, val double")
    asks = spark.createDataFrame([("a", 3)], "sample string, at int")
    plan = T.running_totals(points, asks, ["sample"])._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^,]+), ([^,]+),", plan)
    # the only window over a whole group goes over its spans
    assert windows and all("__span" in part or "__span" in order for part, order in windows)


def test_lists_of_hashes_have_the_ancestors_of_their_rows(spark):
    tree = read_tree(spark, "((a:0.1,b:0.1):0.1,(c:0.1,d:0.1):0.1);")
    table = sketch(spark, {"a": {1, 2, 3}, "b": {2, 3}, "c": {3, 4}, "d": {4, 5}})
    listed = table.groupBy("sample").agg(C.F.collect_list("hash").alias("hashes"))
    got = dict(rows(C.kmer_lca(listed, tree)))
    at = {r.name: r.node_id for r in tree.collect()}
    want = {1: at["a"], 2: (at["a"] + at["b"]) // 2, 3: 3, 4: (at["c"] + at["d"]) // 2, 5: at["d"]}
    assert got == dict(rows(C.kmer_lca(table, tree))) == want
