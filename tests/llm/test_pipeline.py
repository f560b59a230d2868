"""The pipeline on a small corpus whose outcome can be worked out by hand."""

import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from kmergrid.llm import minhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_one_after_the_other(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": "river stone lantern meadow copper window", "xx": "zorqu vexol quaxy nthyl plyxo grozz"}

    def prose(lang, n):
        return " ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "ed"]) for _ in range(n))

    item = prose("en", 30)
    rows = [(i, prose(("en", "xx")[i % 2], 60), ("en", "xx")[i % 2], f"s{i % 3}") for i in range(60)]
    copied = rows[4][1].split()
    copied[59] = "changed"
    rows += [(60, rows[4][1], "en", "s0"), (61, " ".join(copied), "en", "s1"), (62, "... 123", "en", "s0"), (63, f"{rows[6][1][:90]} {item} end", "en", "s2"), (64, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    current, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, current, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
        current = corpus_pipeline.materialize(made, name)
        ids.append({r["doc_id"] for r in current.collect()})
    assert ids[0] == set(range(62)) | {63}
    assert ids[1] == ids[0] - {60, 61}
    assert ids[2] == ids[1] - {63}
    assert ids[3] <= ids[2] and ids[4] == ids[3]

    mixed = {r["doc_id"]: r["text"] for r in corpus_pipeline.mixture(spark, docs.where("doc_id < 60"), str(tmp_path)).collect()}
    total = sum(len(re.findall(r"\S+", t)) for t in mixed.values())
    assert abs(total - 1.5 * 60 * 60) <= 3
    assert all(len(t.split()) <= 120 for t in mixed.values())

    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert {r["doc_id"] for r in got} == ids[4] and got == sorted(current.collect())
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = corpus_pipeline.mixture(spark, docs.where(docs["doc_id"].isin(*ids[2])), str(tmp_path)).collect()
    want = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in mixed}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {
        i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_near_copies_from_four_fifths_on_go(spark, tmp_path):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    copies = [list(b) for b in base]
    copies[0][10] = "changed"                      # 51 of 61 shingles in common, 0.836
    copies[1][49:55] = ["changed"] * 6             # 46 of 65, 0.708
    copies[2][4] = "changed"                       # 51 of 61 again
    rows = [" ".join(x) for x in (*base, *copies)]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(rows)], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 4}
    assert {r["doc_id"] for r in minhash.without_duplicates(docs).collect()} == set(range(6))
