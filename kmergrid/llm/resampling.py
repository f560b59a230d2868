"""Importance resampling: draw the documents that look most like a target corpus, by hashed n-gram counts.

The texts of a batch are put together with a separator between them; one pass of a regular expression finds the words
of all, a binary search in the texts' ends gives each word its document, and n-grams whose ends lie in two documents
are masked before anything is counted.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmergrid.llm.common import groups_of
from kmergrid.session import materialize

#: buckets that features are hashed to, and the seed of the noise
BUCKETS = 10_000
SEED = "2024"
#: least words of a document that can be drawn, and the share of those to draw, in per cent
LEAST_WORDS = 20
PERCENT = 10
#: bytes of joined text that one pass looks at
WINDOW = 1 << 20

#: words are ASCII letters and digits and everything beyond ASCII; the separator is neither
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_SEPARATOR = b"\x00"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(texts: Sequence[bytes], longest: int, buckets: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``documents, buckets, words`` of all n-grams of 1 to ``longest`` words of UTF-8 texts.

    Each item covers a window of the joined texts, so a long text takes no more memory than a short one: for every
    n-gram that starts there the index of its text and its bucket, and the index of the text of every word.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined, at = _SEPARATOR.join(texts).translate(_LOWER), 0
    while at < len(joined):
        gap = _GAP.search(joined, at + window)
        stop = gap.start() if gap else len(joined)
        ahead = max((m.end() for m in itertools.islice(_WORD.finditer(joined, stop), longest - 1)), default=stop)
        starts, words = [], []
        for m in _WORD.finditer(joined, at, ahead):
            starts.append(m.start())
            words.append(m[0])
        at = stop
        if not words:
            continue
        first = np.array(starts)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        text, here = np.searchsorted(ends, first, "right"), int(np.searchsorted(first, stop))
        gram, sums = code, [zlib.crc32(w) for w in known]
        found = [(text[:here], np.array(sums, np.int64)[code[:here]] % buckets)]
        alive = np.arange(len(words))
        for n in range(2, longest + 1):
            alive = alive[alive + n - 1 < len(words)]
            alive = alive[text[alive] == text[alive + n - 1]]
            pairs, at_pair = np.unique(gram[alive] * len(known) + code[alive + n - 1], return_inverse=True)
            sums = [zlib.crc32(b" " + known[p % len(known)], sums[p // len(known)]) for p in pairs.tolist()]
            gram = np.zeros(len(words), np.int64)
            gram[alive] = at_pair
            own = alive < here
            found.append((text[alive[own]], np.array(sums, np.int64)[at_pair[own]] % buckets))
        yield np.concatenate([d for d, _ in found]), np.concatenate([b for _, b in found]), text[:here]


def _count(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in groups_of(texts):
            for _, bucket, _ in features(texts[a:b], longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = batch.column(1).to_pylist(), batch.num_rows
        n, words, total = (np.zeros(rows, np.int64) for _ in range(3))
        for a, b in groups_of(texts):
            for text, bucket, word in features(texts[a:b], longest, len(gains)):
                n[a:b] += np.bincount(text, minlength=b - a)
                words[a:b] += np.bincount(word, minlength=b - a)
                # sums of whole numbers, exact in doubles
                total[a:b] += np.bincount(text, gains[bucket], b - a).astype(np.int64)
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        yield pa.record_batch([batch.column(0), pa.array(n), pa.array(words), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])


def _body(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit("")).cast("binary").alias("text")


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all of ``texts(text)``: one number per bucket, whatever the size of the table."""
    parts = texts.select(_body(texts)).mapInArrow(functools.partial(_count, longest=longest, buckets=buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log-ratio of a bucket's smoothed shares in the target and in the documents, rounded down."""
    all_docs, all_target = int(docs.sum()) + len(docs), int(target.sum()) + len(docs)
    return np.array([math.floor(1000 * math.log((t + 1) * all_docs / ((s + 1) * all_target))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.float64)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Weigh all ``docs(doc_id, text)`` by their likeness to ``target(text)`` and draw the best after adding noise.

    Returns ``doc_id, n_features, n_words, weight, score, rank`` for every row of ``docs``.  The weight is the mean gain
    (:func:`bucket_gains`) of the row's n-grams of 1 to ``longest`` words, repeats counted; Gumbel noise, which the seed
    and the id decide, is added to it, so the highest scores are a draw without replacement.  Of the rows with at least
    ``least_words`` words ``percent`` in a hundred (rounded down) get a rank from 1 on; the rank of the others is null.

    A null text is an empty one: no features, weight 0, never drawn.  Ties go to the smaller id, null last, then to
    fewer features; rows that agree in all of it are interchangeable, and each gets its own rank.  Empty tables, of
    either kind, are fine.  Other columns are ignored.

    Only one number per bucket reaches the driver.  Ranks come from the counts of the whole-number scores (a gain is
    within 1000 times the log of the largest count, the noise between -3,131 and 22,877: some 100,000 values at most)
    and a window inside one score, which the noise keeps to a three-thousandth of the rows.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, weight long"
    weighed = docs.select("doc_id", _body(docs)).mapInArrow(functools.partial(_weigh, gains=gains, longest=longest), kind)
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "scored")

    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    quota = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    better = counts.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("better")).where(F.col("better") < quota)
    placed = scored.join(F.broadcast(better), "score", "left").withColumn("chosen", able & F.col("better").isNotNull())
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("better") + F.row_number().over(ties)
    first = placed.where("chosen").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = placed.where(~F.col("chosen")).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "n_words", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    ids = resample(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
