import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kmergrid.config import SketchConfig
from kmergrid.operators import sketch as K
from kmergrid.operators.kmers import least_hashes
from kmergrid.session import GROUP_LIMIT
from test_sequence import brute

STREAM = [5, 3, 5, 9, 3, 5, -2, 9, -2]


def counts_of(spark, stream, sample="x"):
    return spark.createDataFrame([(sample, h, n, 0) for h, n in Counter(stream).items()],
                                 "sample string, hash int, cnt bigint, km bigint")


@pytest.mark.parametrize("assembly,min_cov,track,want", [
    (False, 1, True, [(-2, 2), (3, 2)]),
    (False, 2, True, [(-2, 2), (3, 2)]),
    (False, 3, True, [(5, 3)]),
    (True, 2, True, [(-2, 3), (3, 3)]),
    (False, 2, False, [(-2, 0), (3, 0)]),
])
def test_worked_example(spark, assembly, min_cov, track, want):
    config = SketchConfig(3, 2, min_cov, assembly, track)
    got = K.to_sketch(counts_of(spark, STREAM), config).select("hash", "coverage")
    assert rows(got) == want


def test_genome_size_estimate(spark):
    config = SketchConfig(3, 2)
    sketch = K.to_sketch(counts_of(spark, STREAM), config)
    sizes = spark.createDataFrame([("x", 9), ("empty", 1)], "sample string, n_bases bigint")
    assert rows(K.sketch_meta(sketch, sizes, config)) == [("empty", 3, None, 0), ("x", 3, 3, 2)]
    exact = SketchConfig(3, 2, assembly=True)
    assert rows(K.sketch_meta(sketch, sizes, exact)) == [("empty", 3, 1, 0), ("x", 3, 9, 2)]


def make_sequences(seed, hot=False):
    rng = random.Random(seed)
    genome = "".join(rng.choices("ACGT", k=1500))
    out = []
    for _ in range(150):
        start = rng.randrange(0, 1440)
        read = list(genome[start:start + 60])
        if rng.random() < 0.3:
            read[rng.randrange(60)] = rng.choice("ACGTN")
        out.append(("reads", "".join(read)))
    out += [("assembly", genome), ("assembly", "ACG"), ("tiny", "ACGTTGCA"), ("none", "NNNN")]
    if hot:
        out += [("hot", genome[:400])] * 100
    return out


def expected(seqs, config):
    by_sample = {}
    for sample, seq in seqs:
        by_sample.setdefault(sample, Counter()).update(brute(seq, config.kmer_size))
    out = []
    for sample, counter in by_sample.items():
        per = Counter()
        text = {}
        for (kmer, h), n in counter.items():
            per[h] += n
            text[h] = min(kmer, text.get(h, kmer))
        kept = sorted(h for h, n in per.items() if n >= config.effective_min_cov)[:config.sketch_size]
        out += [(sample, h, (per[h] + config.assembly) if config.track_cov else 0, text[h]) for h in kept]
    return sorted(out)


@pytest.mark.parametrize("config", [
    SketchConfig(11, 50, assembly=True, track_cov=True),
    SketchConfig(11, 40, min_cov=3, track_cov=True),
    SketchConfig(35, 30, assembly=True),
])
def test_both_plans_match_brute_force(spark, monkeypatch, config):
    # a narrow first pass makes the widening loop run
    monkeypatch.setattr(K, "FIRST_PASS_ASSEMBLY", 1)
    monkeypatch.setattr(K, "FIRST_PASS_READS", 2)
    monkeypatch.setattr(K, "WIDEN", 4)
    seqs = make_sequences(config.kmer_size, hot=True)
    df = spark.createDataFrame(seqs, "sample string, seq string").repartition(4)
    want = expected(seqs, config)
    assert rows(K.build_sketches(df, config)) == want
    assert rows(K.sketch_plan(df, config)) == want


def test_sketches_of_small_samples_in_one_pass(spark):
    # the hot sample has fewer hashes than its many windows promise, so it is counted in full
    for config in (SketchConfig(11, 50, assembly=True, track_cov=True), SketchConfig(35, 30, assembly=True)):
        seqs = make_sequences(config.kmer_size, hot=True)
        df = spark.createDataFrame(seqs, "sample string, seq string").repartition(4)
        want = expected(seqs, config)
        assert rows(K.record_sketches(df, config)) == want
        listed = least_hashes(df, config.kmer_size, config.sketch_size)
        assert rows(listed) == sorted((s, [r[1] for r in want if r[0] == s]) for s in {r[0] for r in want})


def test_bottom_is_pruned_before_each_shuffle(spark):
    before = spark.conf.get(GROUP_LIMIT, "1000")
    config = SketchConfig(21, 5000, assembly=True)
    plan = K.to_sketch(counts_of(spark, STREAM), config)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 4
    spark.conf.set(GROUP_LIMIT, before)


def test_counts_use_a_hash_aggregate(spark):
    df = spark.createDataFrame([("s", "ACGT" * 9)], "sample string, seq string")
    from kmergrid.operators.kmers import kmers
    text = K.hash_counts(kmers(df, 21))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_coverage_statistics(spark):
    sketch = spark.createDataFrame([("a", c) for c in (2, 2, 4, 8)] + [("b", 5)], "sample string, coverage int")
    assert rows(K.coverage_histogram(sketch)) == [("a", 2, 2), ("a", 4, 1), ("a", 8, 1), ("b", 5, 1)]
    got = {r.sample: (r.n, r.mean, round(r.std_dev, 9), r.median) for r in K.coverage_stats(sketch).collect()}
    assert got == {"a": (4, 4.0, round(6 ** 0.5, 9), 3.0), "b": (1, 5.0, 0.0, 5.0)}
