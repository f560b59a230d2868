"""Every operator against a brute-force version, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kmergrid.llm import (chat, decontaminate, fingerprint, langid, minhash, mixing, pii, sharding, tokens, toxicity)
from kmergrid.llm.encoder import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, words="the of a lantern moved across quiet river stones while nobody in town spoke"):
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", "", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and extra columns with names used inside."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", None, "a"), (4, long, "en", "b"), (5, "word", "de", None),
            (6, "three short words", "en", "a"), (7, "three short words", "en", "b"), (8, "three short words", "en", "b"),
            (9, prose(rng, 40), "en", "a"), (10, "ÀÉ ß 日本語 🙂 12.5", "fr", "é"), (11, "123 456 !!", "en", "a"), (12, long[:4000], None, "b")]
    df = documents(spark, [*rows, rows[8]])
    return df.withColumns({c: F.lit("x") for c in ("score", "_row", "_n", "shard", "slot", "size", "start", "bucket", "rep", "component", "n", "k", "term", "passages")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 -------------------------------------------------------------------------------

def brute_segments(scores):
    """All maximal segments by their definition, recursively: the best one, then what lies left and right of it."""
    def rec(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return [*rec(lo, a), (a, b, best[0]), *rec(b, hi)]
    return rec(0, len(scores))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=16))
def test_segments_are_the_maximal_ones(scores):
    values = [s + i * 1e-4 for i, s in enumerate(scores)]  # no ties
    got = toxicity.maximal_segments(np.array(values, float))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(values)]


def test_toxicity_learns_held_out_texts(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        text, bad = prose(rng, 60).split(), i % 4 == 0
        for w in ("scum", "idiots", "losermann") if bad else ():
            text.insert(rng.randrange(60), w)
        rows.append((i, " ".join(text), "en", "a"))
        marks.append((i, int(bad)))
    found = toxicity.score(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), F.col("doc_id") % 3 != 0).collect()
    assert len(found) == 600
    wrong = [r["doc_id"] for r in found if (r["score"] >= 0.5) != (r["doc_id"] % 4 == 0)]
    assert not wrong
    assert all(bool(r["passages"]) == (r["doc_id"] % 4 == 0) for r in found)


def test_more_word_scores_than_are_broadcast(spark, odd, monkeypatch):
    words = spark.createDataFrame([("three", 1.5), ("lantern", 0.75), ("日本語", 2.0), ("quiet", -1.0)], "word string, score double")
    stems = spark.createDataFrame([("lant", 0.25), ("wor", 9.0), ("word", 1.0), ("ston", 0.5)], "stem string, score double")

    def found():
        rows = toxicity.segments(odd, words, stems).collect()
        return sorted((r["doc_id"], r["tokens"], tuple(tuple(s) for s in r["segments"])) for r in rows)
    broadcast = found()
    monkeypatch.setattr(toxicity, "BROADCAST_FEATURES", 7)
    joined = found()
    assert joined == broadcast and len(joined) == 13 and (5, 1, ((0, 4, 1.0),)) in joined


def test_toxicity_of_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(odd, none, F.lit(True)).collect()
    assert len(rows) == 13 and all(0 <= r["score"] < 0.5 and not r["passages"] for r in rows)
    some = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (6, 1), (9, None), (99, 1), (2, 7)], "doc_id long, toxic int")
    assert len(toxicity.score(odd, some, F.lit(True)).collect()) == 13
    assert toxicity.score(empty, none, F.lit(True)).collect() == []


# --- 2, and the encoder --------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY, cache=50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n\té'sŁ1,!Ġ ", max_size=25), max_size=4))
def test_encoder_is_the_library(encoder, texts):
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.ids(x).tolist() for x in encoder.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n\x01é\u2003ñ,", max_size=60), max_size=4))
def test_encoder_works_off_long_texts_in_parts(encoder, texts):
    with pytest.MonkeyPatch.context() as m:
        m.setattr("kmergrid.llm.encoder.PART", 7)
        got = [encoder.ids(x).tolist() for x in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_near_duplicates_tells_rows_of_one_id_apart(spark):
    rng = random.Random(9)
    x, y, z = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    docs = documents(spark, [(3, x, "en", "a"), (7, x, "en", "a"), (7, y, "en", "a"), (7, z, "en", "b"), (9, z + " more", "en", "a"), (9, z + " more", "en", "a")])
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert found == [(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 7, False), (9, 7, False)]
    kept = minhash.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(3, x), (7, y), (7, z)])


def test_short_clean_texts_keep_their_language(spark):
    rng = random.Random(2)
    words = {"en": "all rights reserved the house of lantern and river", "de": "alle rechte vorbehalten das haus der laterne und fluss"}
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(50)), x, "a") for i, x in enumerate(["en", "de"] * 60)]
    docs = documents(spark, [*rows, (500, "A.\nAll rights reserved.", "en", "a"), (501, "qxzv " * 200, None, "a"), (502, "12 ?", None, "a")])
    kept = {r["doc_id"] for r in langid.accepted(docs, langid.learn(docs)).collect()}
    assert kept == set(range(120)) | {500}


def test_encoder_knows_added_tokens(encoder):
    library, rng, parts = Tokenizer.from_file(VOCABULARY), random.Random(7), ["<|endoftext|>", "<|endof", "text|>", "a", " ", "\n", "b,", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.ids(x).tolist() for x in encoder.encode(texts)] == want
    assert any(50256 in x for x in want)
    plain = Encoder(VOCABULARY, ordinary=True)
    assert all(50256 not in plain.ids(x) for x in plain.encode(texts))


def test_encoding_tasks_get_small_batches(spark, tmp_path, monkeypatch):
    def sizes(batches, **_):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"part": [0], "file": [""], "docs": [batch.nbytes], "tokens": [batch.num_rows]})

    monkeypatch.setattr(tokens, "_write", sizes)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(9000, numPartitions=1).selectExpr("id as doc_id", "repeat('some text ', 200) as text")
    seen = tokens.write_sequences(docs, f"file://{tmp_path}/seq", VOCABULARY).collect()
    assert sum(r["tokens"] for r in seen) == 9000 and max(r["docs"] for r in seen) < 5 << 20
    assert spark.conf.get(key) == before


def test_sequences_round_trip(spark, odd, tmp_path, encoder):
    out = f"file://{tmp_path}/seq"
    files = tokens.write_sequences(odd.repartition(3), out, VOCABULARY, length=64, rows=8).collect()
    got = sorted(tokens.read_documents(spark, out).collect())
    texts = sorted((r["doc_id"], r["text"] or "") for r in odd.collect())
    stream, want = [], []
    for i, t in texts:
        ids = [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    assert [tuple(r) for r in got] == want
    held = []
    for f in sorted(files, key=lambda f: f["base"]):
        shard, own = tokens.Shard(f["file"]), 0
        while own < f["tokens"]:
            ids, mask = shard[own // 64]
            assert len(ids) == len(mask) == 64 and mask.sum() == min(64, f["tokens"] - own)
            held += ids[mask].tolist()
            own += 64
    assert held == stream


def test_sequences_of_nothing(spark, empty, tmp_path):
    tokens.write_sequences(empty, f"file://{tmp_path}/none", VOCABULARY)
    assert tokens.read_documents(spark, f"file://{tmp_path}/none").collect() == []


# --- 3 -------------------------------------------------------------------------------

def plain_patterns(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "256", "4111111111111111", ".", "@", "a", "b-", "-", "+", " ", "(", ")", "%", "x@y.z", "+1 (212) 555-0147"]), max_size=14))
def test_patterns(parts):
    assert pii.base_spans("".join(parts)) == plain_patterns("".join(parts))


def test_field_decodes_like_all_paths_and_learns_its_table():
    table = [pii.parse(s) for s in pii.LABELLED]
    field = pii.fit(table)
    assert field.neutral()
    for words, labels in table:
        assert [pii.LABELS[k] for k in field.decode([field.unary(words)])[0]] == labels
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=(n, len(pii.LABELS))) for n in (1, 3, 4, 4)]
    for u, path in zip(rows, field.decode(rows), strict=True):
        def value(p, u=u):
            ok = pii._STARTS[p[0]] and all(pii._ALLOWED[a, b] for a, b in itertools.pairwise(p))
            return sum(u[i, k] for i, k in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p)) if ok else -1e9
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(len(pii.LABELS)), repeat=len(u)))))
    text = "nothing here, then call (212) 555-0133 or write to kim (at) example.org today. Some more words follow and then 9 end."
    assert pii.model_spans(field, [text]) == pii.model_spans(field, [text], whole=True)
    assert [(k, text[a:b]) for k, a, b in pii.model_spans(field, [text])[0]] == [("phone", "(212) 555-0133"), ("email", "kim (at) example.org")]


def test_pii_of_odd_tables(odd, empty):
    rows = pii.digest(pii.find(odd)).collect()
    assert len(rows) == 13
    assert {r["base_sha256"] for r in rows if not r["spans"]} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(empty).collect() == []


# --- 4 -------------------------------------------------------------------------------

def edit_distance_within(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=70), st.text(alphabet="abc", max_size=80))
def test_bit_parallel_distance(item, text):
    made = decontaminate.Item(0, item, 0)
    assert decontaminate.best_match(made.letters(), len(item), text)[0] == edit_distance_within(item, text)


def test_leaks_against_all_distances(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(6)]
    docs = []
    for d in range(40):
        text = prose(rng, 60)
        if d % 3 == 0:
            cut = list(items[d % 6][1])
            for _ in range(rng.randrange(14)):
                cut[rng.randrange(len(cut))] = rng.choice(["x", "", "yz"])
            text = text[:100] + " " + "".join(cut).upper() + " " + text[100:]
        docs.append((d, text, "en", "a"))
    got = decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for (d, t, *_), (i, body) in itertools.product(docs, items):
        n = decontaminate.normal(body)
        k = edit_distance_within(n, decontaminate.normal(t))
        if k <= int(len(n) * decontaminate.ERRORS):
            want[d, i] = k
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(got) == len(want) >= 8


def test_leaks_of_odd_tables(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "word"), (5, "three short words"), (6, "three short words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, items).collect()}
    assert got == {(5, 4), *itertools.product((6, 7, 8), (5, 6))}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, items).collect()} == got
    kept = decontaminate.without_leaks(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 9, 10, 11, 12}
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.leaks(odd, items.limit(0)).collect() == []


# --- 5 -------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10))
def test_permutation(n, key):
    p = mixing.Permutation(n, key)
    out = p.at(np.arange(n))
    assert sorted(out) == list(range(n)) and (p.where(out) == np.arange(n)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 7))
def test_shard_counts_add_up(counts, size):
    total = sum(counts)
    shards = max(1, -(-total // size))
    before = np.zeros(len(counts), int)
    for k in range(shards):
        at, own = mixing.shard_counts(tuple(counts), size, 3, k)
        assert (at == before).all() and own.sum() == min(size, total - k * size)
        before = before + own
    assert before.tolist() == counts


def test_draws_follow_the_hypergeometric_law():
    counts, some, n = np.array([30, 0, 50, 20]), 40, 4000
    drawn = np.array([mixing._draw(counts, some, np.random.default_rng([1, k])) for k in range(n)])
    assert (drawn.sum(axis=1) == some).all() and (drawn <= counts).all() and (drawn >= 0).all()
    total = counts.sum()
    ways = [math.comb(30, k) * math.comb(total - 30, some - k) / math.comb(total, some) for k in range(31)]
    seen, hoped = np.bincount(drawn[:, 0], minlength=31), np.array(ways) * n
    common = hoped >= 5
    assert ((seen - hoped)[common] ** 2 / hoped[common]).sum() < common.sum() + 5 * (2 * common.sum()) ** 0.5


def test_draws_of_any_size():
    counts = np.array([3 * 10**12, 7, 10**12, 0])
    some, total = 2 * 10**12, 4 * 10**12 + 7
    drawn = np.array([mixing._draw(counts, some, np.random.default_rng([2, k])) for k in range(400)])
    assert (drawn.sum(axis=1) == some).all() and (drawn <= counts).all() and (drawn >= 0).all()
    p = counts[0] / total
    spread = (some * p * (1 - p) * (total - some) / (total - 1)) ** 0.5
    strays = (drawn[:, 0] - some * p) / spread
    assert abs(strays.mean()) < 0.25 and 0.8 < strays.std() < 1.2
    assert mixing._draw(counts, total, np.random.default_rng(3)).tolist() == counts.tolist()
    assert mixing._draw(counts, 0, np.random.default_rng(3)).tolist() == [0, 0, 0, 0]


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 0], [3, 1, 2], 90) == [20, 70, 0]
    assert sum(mixing.targets([10, 20, 30], [3, 1, 2], 90)) == pytest.approx(90)


def test_mix_takes_words_and_texts(spark, odd):
    rng = random.Random(4)
    docs = documents(spark, [(i, prose(rng, 1 + i % 90), "en", f"s{i % 4}") for i in range(300)])
    rows = {r["doc_id"]: r for r in mixing.taken(docs, block=16, shard_blocks=32).collect()}
    again = {r["doc_id"]: r for r in mixing.taken(docs.repartition(5), block=16, shard_blocks=32).collect()}
    assert rows == again and all(r["taken"] <= 2 * r["size"] for r in rows.values())
    for s in range(4):
        own = [r for i, r in rows.items() if i % 4 == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.mixed_documents(docs, block=16, shard_blocks=32).collect():
        got = WORD.findall(r["text"])
        assert len(got) == rows[r["doc_id"]]["taken"] and set(got) <= set(WORD.findall(texts[r["doc_id"]]))
    assert len(mixing.taken(odd).collect()) >= 13
    assert mixing.mixed_documents(odd).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mix_of_nothing(empty):
    assert mixing.taken(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


# --- 6 -------------------------------------------------------------------------------

def test_shards(spark, odd, empty):
    docs = documents(spark, [(i, "x" * (i % 7), "en", f"s{i % 3 if i % 2 else 0}") for i in range(1001)])
    rows = sharding.shard(docs, 10).collect()
    per = collections.Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and len(rows) == 1001
    for k in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(per[k]))
    for s in ("s0", "s1", "s2"):
        own = collections.Counter(r["shard"] for r in rows if r["source"] == s)
        assert max(own.values()) - min(own[k] for k in per) <= 2
    few = sharding.shard(odd, 40).collect()
    assert len(few) == 13 and {r["slot"] for r in few} == {0}
    assert {r["size"] for r in few if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard(empty).collect() == []


# --- 7 -------------------------------------------------------------------------------

def brute_components(rows):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(lower).decode())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(120)] = f"z{rng.randrange(1000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = [*enumerate([*rows, "one two", "One  TWO", None, "", "  "])]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    kept = minhash.without_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def families(seed, members):
    """Two families of near copies: bases alike by about 0.73, members of one family by about 0.9."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    second = [f"v{w}" if i % 33 == 5 else w for i, w in enumerate(base)]
    out = []
    for of in (base, second):
        for _ in range(members):
            copy = list(of)
            copy[rng.randrange(200)] = f"z{rng.randrange(10 ** 6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def test_related_families_do_not_meet_pair_by_pair(spark, monkeypatch):
    plain, asked = minhash._candidates, []

    def counted(pairs, percent):
        asked.append(pairs.count())
        return plain(pairs, percent)

    monkeypatch.setattr(minhash, "_candidates", counted)
    monkeypatch.setattr(minhash, "FAMILY", 4)  # as small beside these families as the real one beside families of a thousand
    for members in (30, 90):
        rows = families(members, members)
        asked.clear()
        df = documents(spark, [(i, t, "en", "a") for i, t in rows])
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
        assert got == brute_components(rows)
        assert len({c for _, c in got.values()}) == 2
        assert sum(asked) <= 20 * members  # a family alone has members ** 2 / 2 pairs, 4,050 of the larger ones


def test_hubs_without_links_share_their_members(spark, monkeypatch):
    rng, plain, rows = random.Random(12), minhash._beyond_hubs, []

    def counted(apart, percent):
        rows.append(apart.count())
        return plain(apart, percent)

    monkeypatch.setattr(minhash, "_beyond_hubs", counted)
    texts = []
    for i in range(120):  # pairs are alike by about 0.66, so many meet in buckets, and only each tenth has a near copy
        copy = [f"w{k}" for k in range(200)]
        for k in range(4):
            copy[rng.randrange(200)] = f"z{i}x{k}"
        texts.append(" ".join(copy))
        if i % 10 == 0:
            copy[rng.randrange(200)] = f"y{i}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    given = list(enumerate(texts))
    df = documents(spark, [(i, t, "en", "a") for i, t in given])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(given) and sum(i != c for i, (_, c) in got.items()) >= 12
    assert sum(rows) <= 2 * len(given)


def test_near_duplicates_of_odd_tables(odd, empty):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: i if i not in (7, 8) else 6 for i in range(1, 13)}
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
    assert minhash.near_duplicates(empty).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(900, i) for i in range(200, 230)]
    got = dict(tuple(r) for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 200 for i in range(200, 230)}, 900: 200}


# --- 8 -------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", "TEXT]", "a", "</s>", "[INST]"]), max_size=10))
def test_escapes_are_reversible(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (2, 0, None, None), (2, 1, "assistant", ""), (3, 5, "system", "é \\<s>"),
            (3, 6, "assistant", "x [TEXT] <\\s>"), (3, 6, "assistant", "x"), (None, None, "user", "no id"), *((4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(2500))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"start": F.lit(1), "ids": F.lit("x")})
    made = chat.format_conversations(df.repartition(4), VOCABULARY)
    got = {r["conv_id"]: r for r in chat.read_back(made, VOCABULARY).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    for c in (1, 2, 4):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    form = "<s>" + "".join(f"[INST]{r}[TEXT]{chat.escape(t)}{'</s>' if r == 'assistant' else '[/INST]'}" for _, _, r, t in rows[:2])
    assert got[1]["formatted_chars"] == len(form)
    assert chat.read_back(chat.format_conversations(df.limit(0), VOCABULARY), VOCABULARY).collect() == []


# --- 9 -------------------------------------------------------------------------------

def brute_grams(text):
    out = []
    for run in re.findall(r"[^\W\d_]+", text):
        padded = f" {run.lower()} "
        out += [padded[k:k + 3] for k in range(len(padded) - 2)]
    return collections.Counter(out)


def test_grams():
    texts = ["Hello, wörld", "", "a b1c", "...", "ÀÉÎ"]
    codes, owner = langid.grams(texts)
    for i, t in enumerate(texts):
        want = brute_grams(t)
        assert collections.Counter(codes[owner == i].tolist()).total() == want.total()
        assert sorted(collections.Counter(codes[owner == i].tolist()).values()) == sorted(want.values())
    assert langid.grams(["world"])[0].tolist() == langid.grams(["x", "WORLD"])[0].tolist()[1:]


def test_filters_find_every_member_and_count_false_hits():
    rng = np.random.default_rng(1)
    members = {k: rng.integers(0, 2**63, 3000).astype(np.uint64) for k in range(70)}
    f = langid.Filters.build([f"l{k:02}" for k in range(70)], members)
    for k in (0, 63, 64, 69):
        assert ((f.masks(members[k])[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    other = f.masks(rng.integers(0, 2**63, 200_000).astype(np.uint64))
    rate = ((other[:, 0] >> np.uint64(5)) & np.uint64(1)).mean()
    assert abs(rate - f.false[5]) < 0.002


def test_languages(spark, odd, empty):
    rng = random.Random(8)
    made = {"aa": "bado kelu mira sotu", "bb": "xyntha zorqui vexol quax", "cc": "straum hjelp fjord blom"}
    rows = [(i, prose(rng, 30, made[lang]), lang if i % 11 else None, "a") for i in range(300) for lang in [list(made)[i % 3]]]
    filters = langid.learn(documents(spark, rows).where("doc_id < 200"))
    got = langid.identify(documents(spark, rows), filters).collect()
    assert all(r["lang_pred"] == list(made)[r["doc_id"] % 3] and 0.5 < r["score"] <= 1 for r in got)
    strange = {r["doc_id"]: r for r in langid.identify(odd, filters).collect()}
    assert all(strange[i]["lang_pred"] == "und" and strange[i]["score"] == 0 for i in (1, 2, 3, 11)) and strange[5]["lang_pred"] != "und"
    assert {r["doc_id"] for r in langid.accepted(documents(spark, [*rows[:9], (900, "...", "aa", "a")]), filters).collect()} == set(range(9))
    nothing = langid.learn(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"} and langid.identify(empty, filters).collect() == []


# --- 10 ------------------------------------------------------------------------------

def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(20, 200), "alpha beta gamma delta epsilon zeta eta theta iota kappa") + f" id{i % 7}" for i in range(60)]
    texts[5] = texts[9]
    df = documents(spark, [(i * 3, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"] // 3: r for r in fingerprint.fingerprints(df, 64).collect()}
    bag, gaps = (lambda t: collections.Counter(t.lower().split())), []
    for i, t in enumerate(texts):
        k, after = len(t) // 3, texts[(i - 1) % 60]
        edited = t[:len(t) - k] + after[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        gaps += [got[i]["near_edited"] - jaccard(bag(t), bag(edited)), got[i]["near_next"] - jaccard(bag(t), bag(after))]
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.09
    assert got[5]["fingerprint"] == got[9]["fingerprint"]


def test_likeness_at_the_production_count(spark):
    blocks = [" ".join(f"w{b}x{j}" for j in range(20)) for b in range(402)]
    df = documents(spark, [(i, " ".join(blocks[i:i + 3]), "en", "a") for i in range(400)])
    got = [r for r in fingerprint.fingerprints(df).collect() if r["doc_id"]]  # the next of 0 is 399, with nothing in common
    gaps = np.array([r["near_next"] - 0.5 for r in got])  # two blocks of four
    assert len(gaps) == 399 and abs(gaps.mean()) < 0.015
    assert np.sqrt((gaps ** 2).mean()) < 0.08  # 0.072 for 48 samples, 0.088 for 32


def test_fingerprints_of_odd_tables(odd, empty):
    made = fingerprint.fingerprints(odd, 8).collect()
    got = {r["doc_id"]: r for r in made}
    assert len(made) == 13 and set(got) == set(range(1, 13)) and got[1]["fingerprint"] == got[2]["fingerprint"] == "0" * 64
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[2]["near_next"] == 1.0 and got[4]["near_next"] == 0.0
    assert fingerprint.fingerprints(empty, 8).collect() == []


def test_fingerprints_keep_every_row(spark):
    texts = [(1, "a b c d e f"), (1, "other words of one id"), (1, "a b c d e f"), (None, "no id at all"), (None, None), (2, "last of the ids")]
    df = documents(spark, [(i, t, "en", "a") for i, t in texts])
    made = fingerprint.fingerprints(df, 8).collect()
    size = collections.Counter((i, len(t or "")) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in made) == size
    second = next(r for r in made if r["doc_id"] == 2)
    heads = {hashlib.sha256(("last of th" + t[:5]).encode()).hexdigest() for t in ("a b c d e f", "other words of one id")}
    assert second["edited_sha256"] in heads  # the next one has id 1
    assert len({r["fingerprint"] for r in made if r["n_chars"] == 11}) == 1


def test_words_and_samples_stay_where_their_text_is(spark, monkeypatch):
    plain, plans = fingerprint.materialize, []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(fingerprint, "materialize", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fingerprint.fingerprints(documents(spark, [(i, f"a b c d{i}", "en", "a") for i in range(20)]), 8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\((.*)\)", plans[-1])
    assert dealt and not [by for by in dealt if re.search(r"\b(term|g|k|word|_groupingexpression)#", by)]
