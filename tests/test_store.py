import random

import pytest

from conftest import rows
from kmergrid.config import SketchConfig
from kmergrid.operators import sketch as K
from kmergrid.operators import store
from test_sketch import make_sequences

SCHEMA = "sample string, seq string"


def parts(seed, n):
    """The sequences of a test table dealt over ``n`` arrivals, and one more with a sample of its own."""
    seqs = make_sequences(seed)
    rng = random.Random(seed)
    dealt = [[] for _ in range(n)]
    for s in seqs:
        dealt[rng.randrange(n)].append(s)
    return seqs + [("late", "ACGTTGCATTAGACCA")], [*dealt, [("late", "ACGTTGCATTAGACCA")]]


@pytest.mark.parametrize("config", [SketchConfig(9, 40, 2, track_cov=True), SketchConfig(9, 40, 3, track_cov=True),
                                    SketchConfig(9, 60, assembly=True, track_cov=True), SketchConfig(9, 5000, 2, track_cov=True)])
def test_merged_sketch_is_that_of_all_input(spark, tmp_path, config):
    seqs, arrivals = parts(config.sketch_size, 3)
    path = str(tmp_path / "store")
    for part in arrivals:
        store.append(path, *store.summarize(spark.createDataFrame(part, SCHEMA), config))
    want = rows(K.sketch_plan(spark.createDataFrame(seqs, SCHEMA), config))
    assert want and rows(store.stored_sketch(spark, path, config)) == want

    # merges of merges, and input after a merge
    second = str(tmp_path / "second")
    store.compact(spark, path, second, config)
    more = [("reads", "ACGTTGCATTAGACCATTTTACGGA"), ("late", "GGGGCCATCTTAA")] * 2
    store.append(second, *store.summarize(spark.createDataFrame(more, SCHEMA), config))
    assert rows(store.stored_sketch(spark, second, config)) == rows(K.sketch_plan(spark.createDataFrame(seqs + more, SCHEMA), config))
    _, bounds = store.load(spark, second, config)
    lengths = {}
    for sample, seq in seqs + more:
        lengths[sample] = lengths.get(sample, 0) + len(seq)
    assert {r["sample"]: r["n_bases"] for r in bounds.collect()} == lengths


def test_a_full_summary_holds_nothing_beyond_its_sketch(spark):
    config = SketchConfig(9, 40, 2)
    counts, bounds = store.summarize(spark.createDataFrame(make_sequences(3), SCHEMA), config)
    bound = {r["sample"]: r["bound"] for r in bounds.collect()}
    assert bound["reads"] < K.INT_MAX and bound["tiny"] == bound["none"] == K.INT_MAX
    held = counts.where("sample = 'reads'").collect()
    assert max(r["hash"] for r in held) == bound["reads"] and sum(r["cnt"] >= 2 for r in held) == 40
    assert any(r["cnt"] == 1 for r in held)


def test_other_settings_are_refused(spark, tmp_path):
    path, seqs = str(tmp_path / "store"), spark.createDataFrame([("x", "ACGTTGCATTAGACCA")], SCHEMA)
    store.append(path, *store.summarize(seqs, SketchConfig(9, 40, 2)))
    for config in (SketchConfig(7, 40, 2), SketchConfig(9, 41, 2), SketchConfig(9, 40, 3), SketchConfig(9, 40, assembly=True)):
        with pytest.raises(ValueError, match="other settings"):
            store.load(spark, path, config)
    with pytest.raises(ValueError, match="at most"):
        store.summarize(seqs, SketchConfig(35, 40))


def test_nothing_in_nothing_out(spark, tmp_path):
    path, config = str(tmp_path / "store"), SketchConfig(9, 40, 2)
    store.append(path, *store.summarize(spark.createDataFrame([], SCHEMA), config))
    assert rows(store.stored_sketch(spark, path, config)) == []
