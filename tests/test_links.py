"""Trees from links, Newick lines and spanning trees, and values by contraction, against versions that walk the tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kmergrid.operators import dendrogram as D
from kmergrid.operators import linkage
from kmergrid.operators import tree as T
from kmergrid.operators.contraction import midpoints
from kmergrid.operators.intervals import interval_join
from kmergrid.operators.numbering import list_sums, ranked, renumber
from kmergrid.sources import newick
from kmergrid.sources.newick_table import PROBLEMS, parse_lines, read_trees

from conftest import rows

LINKS = "tree string, parent string, child string, side int, name string, dist double"


def random_newick(rng, leaves, chain=False):
    parts = [f"s{i}" for i in range(leaves)]
    rng.shuffle(parts)
    while len(parts) > 1:
        i, j = (0, 1) if chain else rng.sample(range(len(parts)), 2)
        a, b = parts[i], parts[j]
        parts = [p for k, p in enumerate(parts) if k not in (i, j)]
        parts.insert(0, f"({a}:{rng.randrange(9) / 4},{b}:{rng.randrange(9) / 4})")
    return parts[0] + ";"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return {"bushy": random_newick(rng, 40), "chain": random_newick(rng, 60, True), "two": random_newick(rng, 2)}


def test_links_become_the_tree_that_was_read(spark, texts):
    links, want = [], []
    for t, text in texts.items():
        for r in newick.tree_rows(text):
            want.append((t, f"k{r[0] * 7 % 1009}", *r))
            if r[1] is not None:
                links.append((t, f"k{r[1] * 7 % 1009}", f"k{r[0] * 7 % 1009}", int(r[0] > r[1]), r[5], r[6]))
    random.Random(1).shuffle(links)
    assert rows(renumber(spark.createDataFrame(links, LINKS))) == sorted(want)


def test_links_that_are_no_tree(spark):
    two_roots = [("t", "a", "b", 0, "b", 1.0), ("t", "a", "c", 0, "c", 1.0)]
    ring = [("t", "a", "b", 0, None, 1.0), ("t", "a", "x", 1, "x", 1.0), ("t", "b", "a", 0, None, 1.0), ("t", "b", "y", 1, "y", 1.0)]
    shared = [("t", "a", "b", 0, "b", 1.0), ("t", "a", "c", 1, None, 1.0), ("t", "c", "b", 0, "b", 1.0), ("t", "c", "d", 1, "d", 1.0)]
    for links in (two_roots, [two_roots[0]], shared):
        with pytest.raises(ValueError):
            renumber(spark.createDataFrame(links, LINKS))
    with pytest.raises(ValueError):
        renumber(spark.createDataFrame(ring, LINKS)).collect()
    assert renumber(spark.createDataFrame([], LINKS)).collect() == []


def test_sums_along_lists(spark):
    items = [(i, i + 1 if i % 10 < 9 else None, i) for i in range(40)]
    want = [(i, sum(range(i, i // 10 * 10 + 10))) for i in range(40)]
    assert rows(list_sums(spark.createDataFrame(items, "item long, next long, v long"), ["v"])) == want


def test_ranks_over_all_partitions(spark):
    values = [((i * 37) % 101, i % 3) for i in range(101)]
    got = ranked(spark.createDataFrame(values, "a int, b int").repartition(5), F.desc("a"), "b")
    assert [r["rank"] for r in sorted(got.collect(), key=lambda r: -r["a"])] == list(range(101))


def test_lines_are_read_like_tree_files(spark, texts):
    rng = random.Random(8)
    lines = [*texts.values(), " (a:1 , b:-2.5) ; ", "((a:1,b:1),c:2);", "(a:1,,b:1e-1);", "(a:1((b:1,c:1):2,d:1):1);", "(a b:1,c:1);"]
    lines += ["", "a:1;", "(a:1,b:1)", "(a:1,b:1)x;", "((a:1,b:1):1,c:1;", "(a:1,b:1));", "(a:1,b:1),(c:1,d:1);", ")a:1,b:1(;", "(a,b:1);", "(a:b:1,c:1);", "((a:1,b:1)x:1,c:1);",
              "(:1,b:1);", "(a:1);", "(a:1,b:1,c:1);", "();", "((),a:1);", "(a:1,a:1);", "(a:one,b:1);", "(a:,b:1);"]
    lines += ["".join(rng.choice(["(", ")", ",", "a:1", "b:2", "c", ":3", ";"]) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(len(lines), None)], "tree int, text string")
    want, wrong = [], {len(lines)}
    for i, x in enumerate(lines):
        try:
            want += [(i, *r) for r in newick.tree_rows(x)]
        except ValueError:
            wrong.add(i)
    links, problems = parse_lines(table)
    told = {r["tree"]: r["problem"] for r in problems.collect()}
    assert set(told) == wrong and set(told.values()) == set(PROBLEMS)
    assert rows(renumber(links).drop("key")) == sorted(want)
    assert rows(read_trees(table.where("tree < 3"))) == sorted(w for w in want if w[0] < 3)


def test_values_by_contraction(spark, texts):
    rng = random.Random(2)
    for text in texts.values():
        nodes = {r[0]: r for r in newick.tree_rows(text)}
        value = {i: rng.random() for i, r in nodes.items() if r[4]}
        given = spark.createDataFrame(list(value.items()), "node_id int, val double")
        for i, r in sorted(nodes.items(), key=lambda x: -x[1][7]):
            if not r[4]:
                value[i] = (value[r[2]] + value[r[3]]) / 2
        got = dict(tuple(r) for r in midpoints(newick.read_tree(spark, text), given).collect())
        assert got == pytest.approx(value)


def test_positions_in_intervals(spark):
    rng = random.Random(3)
    spans = [(i, lo := rng.randrange(20_000), lo + rng.choice([0, 1, 15, 16, 300, 9000])) for i in range(60)] + [(99, 0, 30_000), (98, 5, 4)]
    points = [rng.randrange(31_000) for _ in range(500)]
    got = interval_join(spark.createDataFrame([(p,) for p in points], "pos long"), spark.createDataFrame(spans, "id int, lo long, hi long"))
    assert rows(got.select("id", "pos")) == sorted((i, p) for i, lo, hi in spans for p in points if lo <= p <= hi)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_leaf_names_without_an_array_of_the_root(spark, texts):
    tree = newick.read_tree(spark, texts["bushy"])
    names = {r["node_id"]: r["name"] for r in tree.collect() if r["is_leaf"]}
    got = T.leaf_names(tree)
    assert rows(got) == sorted((r["node_id"], names[i]) for r in tree.collect() for i in range(r["lo"], r["hi"] + 1) if i in names)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    below = T.ancestors(tree)
    assert below.count() == sum(r["hi"] - r["lo"] + 1 for r in tree.collect())


@pytest.mark.parametrize(("kind", "n", "block"), [("random", 24, 8), ("path", 9, 3), ("ties", 12, 100)])
def test_dendrogram_is_the_one_that_union_find_gives(spark, kind, n, block):
    rng, edges = random.Random(n), []
    for i in range(1, n):
        a, b = sorted((f"s{i}", f"s{i - 1 if kind == 'path' else rng.randrange(i)}"))
        edges.append((a, b, float(i) if kind == "path" else 1.0 if kind == "ties" else rng.random()))
    table = spark.createDataFrame(edges, "a string, b string, distance double")
    assert rows(D.dendrogram_tree(table, block)) == sorted(newick.tree_rows(linkage.to_newick(edges)))
    if block > n:
        nodes = sorted(D.dendrogram(table, block).collect())
        assert [r["height"] for r in nodes] == sorted(e[2] for e in edges) and nodes[-1]["members"] == n
        assert all(r["left_name"] < r["right_name"] for r in nodes) and [r["parent"] for r in nodes].count(None) == 1


@pytest.mark.parametrize("seed,jaccard", [(1, False), (2, True), (3, False), (4, False)])
def test_spanning_tree_of_sketches_is_that_of_all_pairs(spark, seed, jaccard):
    """Copies, sketches that begin alike, sketches that share nothing; by join and by grid."""
    from kmergrid.config import DistanceConfig
    from kmergrid.operators import distance
    rng = random.Random(seed)
    pool = [sorted(rng.sample(range(60 if seed < 4 else 12), rng.randrange(1, 7))) for _ in range(7)]
    pool += [pool[0][:2], [*pool[1], 70]]
    sketches = {f"s{i}": rng.choice(pool) for i in range(16)}
    table = spark.createDataFrame([(n, h) for n, s in sketches.items() for h in s], "sample string, hash int")
    config = DistanceConfig(5, jaccard)
    want = rows(linkage.spanning_tree(distance.pairwise(table, config)))
    assert len(want) == 15 and rows(linkage.sketch_spanning_tree(table, config)) == want


@pytest.mark.parametrize("edges_held", [1, 1 << 20])
def test_grid_hands_on_only_edges_that_a_tree_can_use(spark, monkeypatch, edges_held):
    # all pairs that share a hash were joined and shuffled, their number grows with the square of the samples
    from kmergrid.config import DistanceConfig
    from kmergrid.operators import distance
    monkeypatch.setattr(distance, "EDGES", edges_held)
    rng = random.Random(9)
    table = spark.createDataFrame([(f"s{i:02d}", h) for i in range(60) for h in rng.sample(range(40), rng.randrange(8, 20))], "sample string, hash int")
    arrays, config = distance.hash_arrays(table), DistanceConfig(5)
    near = linkage._sharing_pairs(arrays, config).localCheckpoint()
    everything = distance.pairwise(table, config).where("shared > 0")
    assert near.count() < everything.count() / 2
    assert near.join(everything, ["a", "b", "distance"]).count() == near.count()
    assert rows(linkage.spanning_tree(near)) == rows(linkage.spanning_tree(everything))


def test_forest_of_numbered_edges_is_kruskals():
    import numpy as np
    from kmergrid.operators.distance import _lightest
    rng = random.Random(2)
    for _ in range(40):
        n, m = rng.randrange(1, 30), rng.randrange(60)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        comp, want = list(range(n)), []
        for k, (u, v) in enumerate(edges):
            if comp[u] != comp[v]:
                want.append(k)
                comp = [comp[u] if c == comp[v] else c for c in comp]
        got = _lightest(n, *(np.array([e[s] for e in edges], dtype=np.int64) for s in (0, 1)))
        assert got.tolist() == want
