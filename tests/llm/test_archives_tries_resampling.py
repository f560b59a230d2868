"""The trie of conversation prefixes, importance resampling and seekable WARC bundles against brute-force versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmergrid.llm import prefix_trie, resampling, warc

# --- 11 ------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:2], *r[3:]))


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        built[c] = (own.get(c - c % 100, [])[:h] if c is not None else []) + turns[h:]
    return built


def brute_nodes(built):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)

    def least(node):
        return min((c for c in members[node] if c is not None), default=None)

    kids, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    return ordered((least(n), len(n), least(n[:-1]) if n else None, len(members[n]), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(x for x in ends[n] if x is not None)).encode()).hexdigest()) for n in members)


def nodes(df):
    return ordered(tuple(r[c] for c in NODE) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_is_that_of_brute_force(spark, shards):
    rng, rows = random.Random(shards), []
    for c in [*range(0, 90), *range(200, 330), 70_000, 131_080]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "ccc"])) for t in range(rng.randrange(1, 9))]
    rows += [(400 + c, t, "user", f"same {t}") for c in range(60) for t in range(7)]     # copies
    rows += [(500, None, None, None), (500, 3, "user", None), (501, 0, "x", "y")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("path", "key", "shard", "n", "block", "depth")})
    built = prefix_trie.rebuilt(prefix_trie.conversations(df))
    assert nodes(prefix_trie.trie(built, shards)) == brute_nodes(brute_rebuilt(rows))


def test_trie_of_odd_conversations(spark):
    rows = [(None, 0, "user", "b"), (None, 1, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 0, "u", "x" * 100_000), (3, 0, None, None)]
    rows += [(4, t, "user", "deep") for t in range(3000)] + [(5, t, "user", "deep") for t in range(2000)]
    got = nodes(prefix_trie.prefix_nodes(spark.createDataFrame(rows, TURNS), 4))
    own = defaultdict(list)
    for c, _, r, t in rows:
        own[c].append((r or "", t or ""))
    want = {}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = [hashlib.md5(repr(turns[:d]).encode()).hexdigest() for d in range(len(turns) + 1)] if len(turns) < 100 else None
        key = [(d, h[d]) for d in range(len(turns) + 1)] if h else [(0, hashlib.md5(b"[]").hexdigest()), *((d, "deep") for d in range(1, len(turns) + 1))]
        for k in key:
            members[k].append(c)
        ends[key[-1]].append(c)
    want = Counter((min(x for x in v if x is not None) if any(x is not None for x in v) else None, k[0], len(v)) for k, v in members.items())
    assert Counter((r[0], r[1], r[3]) for r in got) == want
    root = next(r for r in got if r[1] == 0)
    assert root[:6] == (1, 0, None, 6, 4, 5)
    assert [r for r in got if r[1] == 3000][0] == (4, 3000, 4, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())
    assert [r for r in got if r[1] == 2000][0] == (4, 2000, 4, 2, 1, 1, 4, hashlib.sha256(b"5").hexdigest())
    alone = [r for r in got if r[0] is None]
    assert alone == [(None, 2, 1, 1, 0, 1, 0, hashlib.sha256(b"").hexdigest())]
    assert nodes(prefix_trie.prefix_nodes(spark.createDataFrame([], TURNS))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=5), min_size=1, max_size=30), st.integers(1, 9))
def test_what_lies_in_two_shards_is_in_the_skeleton(turns, shards):
    paths = sorted({b"".join(hashlib.md5(t.encode()).digest() for t in p) for p in turns})
    splitters = prefix_trie.choose_splitters(paths, shards)
    held = prefix_trie.skeleton(splitters)
    seen = defaultdict(set)
    for p in paths:
        for i in range(0, len(p) + 1, prefix_trie.WIDTH):
            seen[p[:i]].add(sum(s <= p for s in splitters))
    assert all(len(v) == 1 or k in held for k, v in seen.items())
    assert len(prefix_trie.skeleton(prefix_trie.choose_splitters(paths, shards, 3))) <= 4


def test_ids_of_many_blocks_are_in_order(spark):
    step = prefix_trie.ID_BLOCK // 3
    turns = spark.range(0, 40).select((F.col("id") * step).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = nodes(prefix_trie.prefix_nodes(turns, 3))
    assert got[1] == (0, 1, 0, 40, 0, 1, 78, hashlib.sha256(",".join(str(i * step) for i in range(40)).encode()).hexdigest())


# --- 12 ------------------------------------------------------------------------------

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return _WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_buckets(text, longest, buckets):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab B\n\x00é日9.", max_size=30), max_size=6), st.integers(1, 4), st.sampled_from([1, 5, 1 << 20]))
def test_features_of_joined_texts(texts, longest, window):
    found, words = defaultdict(Counter), Counter()
    for doc, bucket, word in resampling.features([t.encode() for t in texts], longest, 97, window):
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            found[d][b] += 1
        words.update(word.tolist())
    assert {i: Counter(brute_buckets(t, longest, 97)) for i, t in enumerate(texts) if brute_words(t)} == found
    assert {i: len(brute_words(t)) for i, t in enumerate(texts) if brute_words(t)} == words


def brute_resample(docs, target, longest, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(brute_buckets(x, longest, buckets))
    for x in target:
        t.update(brute_buckets(x, longest, buckets))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for i, x in docs:
        own = brute_buckets(x, longest, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute_words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_that_of_brute_force(spark, longest):
    rng = random.Random(longest)
    vocabulary = "river stone Lantern meadow copper window 12 ünder 日本 the of".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " .,\n"), (None, "river " * 30), (1003, "stone lantern " * 90_000), (5, rows[5][1]), (5, rows[5][1]), (1004, "a-b" * 25)]
    target = ["river stone river stone", None, "", "copper 日本"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("score", "rank", "bucket", "n", "weight", "better")})
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(docs, aims, longest, 500, 30, 10)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr) \
        == brute_resample(rows, target, longest, 500, 30, 10)
    kept = resampling.drawn(docs, aims, longest=longest, buckets=500, percent=30, least_words=10)
    want = {r[0] for r in brute_resample(rows, target, longest, 500, 30, 10) if r[4] and r[0] is not None}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    some = spark.createDataFrame([(i, "one two three " * 10) for i in range(20)], "doc_id long, text string")
    got = resampling.resample(some, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


# --- 13 ------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def brute_catalog(rows, least=0):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is None, rows[i][1] or "", i))
    first, out = {}, []
    for i in order:
        page, _, html = rows[i]
        data = (html or "").encode()
        again = data in first and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "frame"), [(0, 1 << 18), (6, 300)])
def test_archives_are_read_back(spark, tmp_path, least, frame):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i % 7} ü\r\nx", "".join(rng.choice("<p>é\r\n\x00日") for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(300 + i, None, "twice") for i in range(9)] + [(400 + i, "u", "longer text") for i in range(9)]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(7, "other", rows[7][2]), (None, None, None), (None, None, None), (None, "u", "alone"), (500, "u", "x" * 3_000_000), (501, "WARC/1.1\r\n\r\n", "WARC/1.1\r\n\r\n")]
    out = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(rows, PAGES).repartition(5).withColumns({c: F.lit(1) for c in ("sha", "n", "copy", "file", "first_id", "record_id", "shared")})
    index = warc.write_archives(pages, out, least, frame)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.catalog(spark, out).collect()), key=repr)
    assert got == brute_catalog(rows, least)
    listed = index.collect()
    assert len({r["record_id"] for r in listed}) == len(rows)

    # by place, without Spark, and as one stream that any reader can unpack
    bundles = {r["file"]: warc.Bundle(r["file"]) for r in listed}
    for r in rng.sample(listed, 40):
        offset, heads, _ = next(warc.parse(bundles[r["file"]].frame(r["frame"]), r["offset"]))
        assert offset == r["offset"] and heads["warc-record-id"] == f"<{r['record_id']}>"
    for path, bundle in bundles.items():
        plain = b"".join(bundle.frame(i) for i in range(len(bundle)))
        with open(path.removeprefix("file://"), "rb") as f:
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == plain
        assert sum(1 for _ in warc.parse(plain)) == sum(r["file"] == path for r in listed)
    wanted = index.where("page_id % 10 = 3").select("record_id")
    texts = {i: h.encode() for i, _, h in rows if h is not None and i is not None}
    for r in warc.fetch(spark, out, wanted).collect():
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == texts[r["page_id"]]
    assert warc.fetch(spark, out, wanted).count() == wanted.count() > 0


def test_archives_of_no_pages(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], PAGES), out)
    assert warc.catalog(spark, out).collect() == [] and warc.fetch(spark, out, spark.createDataFrame([("x",)], "record_id string")).collect() == []


def test_copies_of_one_row_are_listed_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 4)
    out = f"file://{tmp_path}/copies"
    index = warc.write_archives(spark.createDataFrame([(1, "u", "same")] * 11 + [(2, "u", "same")], PAGES), out)
    assert len({r["record_id"] for r in index.collect()}) == 12
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.catalog(spark, out).collect())
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 10, (2, "revisit", 1): 1}


def test_gains_round_down():
    got = resampling.bucket_gains(np.array([3, 0]), np.array([0, 1]))
    assert got.tolist() == [math.floor(1000 * math.log(1 * 5 / (4 * 3))), math.floor(1000 * math.log(2 * 5 / (1 * 3)))]
