import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kmergrid.functions import sequence as S
from kmergrid.operators.kmers import canonical_summary, fragments, hash_summary, kmers, window_summary, windows
from kmergrid.plans import catalog

# golden values: canonical k-mer and signed hash
GOLDEN = [
    ("A", "A", -592646229),
    ("ACGT", "ACGT", 1205799342),
    ("AAAAA", "AAAAA", 132498770),
    ("C" * 16, "C" * 16, 1160742823),
    ("ACGTACGTACGTACGTACGTA", "ACGTACGTACGTACGTACGTA", -2137316731),
    ("T" * 21, "A" * 21, 439442724),
    ("GATTACA" * 3, "GATTACA" * 3, 1650849545),
]


def murmur(codes: bytes) -> int:
    """Plain reference implementation for the property tests."""
    m, h = 0xFFFFFFFF, 0x3C074A61
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    full = len(codes) // 4 * 4
    for i in range(0, len(codes), 4):
        k = int.from_bytes(codes[i:i + 4], "little")
        k = rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h ^= k
        if i < full:
            h = (rot(h, 13) * 5 + 0xE6546B64) & m
    h ^= len(codes)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(seq, k):
    seq = "".join(c if c in "ACGT" else "N" for c in seq.upper())
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i:i + k]
        if "N" not in w:
            c = min(w, revcomp(w))
            out.append((c, murmur(bytes("ACGT".index(x) for x in c))))
    return sorted(out)


@pytest.mark.parametrize("kmer,canon,value", GOLDEN)
def test_golden_hash(spark, kmer, canon, value):
    df = spark.createDataFrame([("s", kmer)], "sample string, seq string")
    got = kmers(df, len(kmer)).select(S.unpack(F.col("km"), len(kmer)), "hash").collect()
    assert [tuple(r) for r in got] == [(canon, value)]


@pytest.mark.parametrize("k", [3, 15, 21, 31, 32, 45])
def test_kmers_match_brute_force(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGTacgtNR", weights=[8] * 8 + [1, 1], k=n)) for n in (0, 2, k - 1, k, 400)]
    seqs.append("".join(rng.choices("ACGT", k=300)))
    df = spark.createDataFrame([("s", s) for s in seqs], "sample string, seq string")
    out = kmers(df, k, chunk=37)
    text = S.unpack(F.col("km"), k) if k <= 31 else F.col("kmer")
    assert rows(out.select(text.alias("t"), "hash")) == sorted(x for s in seqs for x in brute(s, k))


def test_hash_filter_plans_quickly(spark):
    """A filter on the hash must not be rewritten through the hash rounds."""
    df = spark.createDataFrame([("s", "ACGT" * 30)], "sample string, seq string")
    out = kmers(df, 21).where("hash <= 0")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert out.count() == sum(h <= 0 for _, h in brute("ACGT" * 30, 21))


def test_counts_of_pieces_add_up(spark, monkeypatch):
    """Counts, smallest k-mers and the smallest hashes of a sample, whatever pieces its records are read in."""
    from kmergrid.functions import hashing
    from kmergrid.operators.kmers import kmer_counts
    monkeypatch.setattr(hashing, "SLICE", 64)
    rng = random.Random(5)
    seqs = [("ab"[i % 2], "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=rng.randrange(60)))) for i in range(40)] + [(None, "ACGTACC"), ("c", None), ("c", "")]
    df = spark.createDataFrame(seqs, "sample string, seq string")
    want = {}
    for sample, seq in seqs:
        for text, h in brute(seq or "", 4):
            n, least = want.get((sample, h), (0, text))
            want[sample, h] = n + 1, min(least, text)

    def added(counts):
        got = counts.groupBy("sample", "hash").agg(F.sum("cnt").alias("n"), F.min("km").alias("km")).select("sample", "hash", "n", S.unpack(F.col("km"), 4))
        return {(r[0], r[1]): (r[2], r[3]) for r in got.collect()}

    assert added(kmer_counts(df, 4)) == want
    low = {s: sorted(h for x, h in want if x == s)[:7] for s in {s for s, _ in want}}
    least = added(kmer_counts(df, 4, least=7))
    assert all(least[s, h] == want[s, h] for s in low for h in low[s])
    small = added(kmer_counts(df.withColumn("top", F.lit(0)), 4, "top"))
    assert small == {k: v for k, v in want.items() if k[1] <= 0}


def test_hashing_plan_has_no_text_functions_by_window(spark):
    """Windows are hashed in the task that reads the text: no row per window is made before."""
    df = spark.createDataFrame([("s", "ACGT" * 30)], "sample string, seq string")
    plan = kmers(df, 21, bound=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 1 and "conv(" not in plan


def test_encode_and_reverse_complement(spark):
    df = spark.createDataFrame([("acgtn",), ("RYK",), ("AACGN",)], "s string")
    got = df.select(S.encode_sequence(F.col("s")), S.reverse_complement(S.encode_sequence(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [("ACGTN", "NACGT"), ("NNN", "NNN"), ("AACGN", "NCGTT")]


def test_windows_and_validity(spark):
    df = spark.createDataFrame([("s", "ACGNACG"), ("t", "AC")], "sample string, seq string")
    w = windows(df, 3)
    assert w.count() == 5
    assert rows(windows(df, 3, chunk=2)) == rows(w)
    valid = w.where(S.is_valid(F.col("kmer"))).select("pos", "kmer", S.canonical(F.col("kmer")))
    assert rows(valid) == [(0, "ACG", "ACG"), (4, "ACG", "ACG")]


def test_fragments_cover_each_window_once(spark):
    df = spark.createDataFrame([("s", "ACGTNACGTACGTACGTAC")], "sample string, seq string")
    frags = [r.frag.decode() for r in fragments(df, 4, chunk=3).collect()]
    got = sorted(f[i:i + 4] for f in frags for i in range(len(f) - 3))
    text = "ACGT", "ACGTACGTACGTAC"
    want = sorted(t[i:i + 4] for t in text for i in range(len(t) - 3))
    assert [g.translate(str.maketrans("0123", "ACGT")) for g in got] == want


def test_windows_are_summed_up_where_they_are_read(spark):
    texts = [(1, "ACGNACGTTGCA"), (1, "TTTTNNACG"), (2, "AC"), (3, "NNNN"), (None, "GATTACA"), (4, "ACGTTGCAACGGTACCATGGCATTGCACGTACGTTGACCATG")]
    df = spark.createDataFrame(texts, "id long, seq string")
    for k in (3, 35):
        w = windows(df, k, ("id",))
        valid = S.is_valid(F.col("kmer"))
        plain = w.groupBy("id").agg(F.count("*"), F.count(F.when(valid, 1)), F.sum(F.when(valid, F.col("pos").cast("bigint"))), F.max("kmer"))
        c = w.where(valid).select("id", "kmer", S.canonical(F.col("kmer")).alias("c"))
        own = c.groupBy("id").agg(F.count(F.when(F.col("kmer") == F.col("c"), 1)), F.min("c"), F.max("c"))
        for chunk in (2, 8192):
            for got, want in ((window_summary(df, k, "id", chunk), plain), (canonical_summary(df, k, "id", chunk), own)):
                assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    for name in ("kmer_windows", "canonical_kmers"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") <= 1  # one for chunks, none for windows


def test_hashes_are_summed_up_in_the_task(spark):
    seqs = spark.createDataFrame([("a", "ACGTNACGGATTACAGATTACA"), ("b", "NNNN"), (None, "ACGTAACCGGTT" * 5), ("a", "GATTACA" * 9), ("c", None)], "sample string, seq string")
    for k in (5, 35):
        want = kmers(seqs, k, hash_only=True, chunk=7).groupBy("sample").agg(F.count(F.lit(1)), F.sum("hash"), F.min("hash"), F.max("hash"))
        got = hash_summary(seqs, k, chunk=7)
        assert sorted(map(str, got.collect())) == sorted(str(x) for x in want.toDF(*got.columns).collect())
        assert got.columns == ["sample", "n", "hash_sum", "hash_min", "hash_max"]


@pytest.mark.parametrize("held,often,filter_bits", [(1 << 22, 8, 1 << 28), (50, 1, 8), (300, 2, 64)])
def test_covered_kmers_are_exact_and_few(spark, monkeypatch, held, often, filter_bits):
    # every distinct hash of a piece was shuffled as a row, however rare
    from kmergrid.config import SketchConfig
    from kmergrid.operators import kmers as M
    from kmergrid.operators import sketch as K
    for name, value in (("HELD", held), ("OFTEN", often), ("FILTER_BITS", filter_bits)):
        monkeypatch.setattr(M, name, value)
    rng = random.Random(held)
    line = "".join(rng.choice("ACGT") for _ in range(30))
    data = [(rng.choice(["x", "y", None]), line * rng.randrange(4) + "".join(rng.choice("ACGTN") for _ in range(rng.randrange(80)))) for _ in range(60)]
    df = spark.createDataFrame([*data, ("z", ""), ("z", "ACG"), ("w", "A" * 40)], "sample string, seq string")
    every = K.hash_counts(M.kmer_counts(df, 11))
    config = SketchConfig(11, min_cov=3)
    found = M.kmer_counts(df, 11, covered=3).localCheckpoint()

    def text(counts):
        return sorted(map(str, K.well_covered(counts, config).select("sample", "hash", "cnt", "km").collect()))

    assert text(K.hash_counts(found)) == text(every) and len(text(every)) > 40
    if filter_bits > 64:
        assert K.hash_counts(found).count() < every.count() / 3


def test_no_covered_kmers_of_nothing(spark):
    from kmergrid.operators.kmers import kmer_counts
    assert kmer_counts(spark.createDataFrame([], "sample string, seq string"), 21, covered=3).count() == 0


def test_sorted_numbers_are_packed_and_come_back():
    import numpy as np
    from kmergrid.functions.hashing import sorted_from_bytes, sorted_to_bytes
    rng = np.random.default_rng(1)
    for n, below in ((0, 10), (1, 1), (1, 1 << 32), (1000, 10), (5000, 1 << 20), (300, 1 << 16), (3, 1 << 50)):
        values = np.sort(rng.integers(0, below, n))
        data = sorted_to_bytes(values, below)
        assert sorted_from_bytes(data, n, below).tolist() == values.tolist()
        assert n < 300 or len(data) * 8 <= n * (max(0, np.log2(below / n)) + 2.1) + 64


def test_shuffle_files_go_with_the_written_step(spark, tmp_path):
    # F1 to F3: the shuffles of finished steps stayed on disk until the driver collected them
    from pathlib import Path
    from kmergrid.session import materialize
    root = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())

    def size():
        return sum(f.stat().st_size for f in root.rglob("shuffle_*.data"))

    before = size()
    out = materialize(spark.range(200_000).repartition(5, "id"), "shuffled")
    assert out.count() == 200_000 and size() < before + 200_000
