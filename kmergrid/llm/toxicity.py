"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmergrid.llm.common import beside
from kmergrid.session import materialize

#: letters of the beginning that unseen words share with seen ones
STEM = 4
#: weight of the Dirichlet priors in texts: of the corpus on a stem, of the stem on a word
PRIOR = 2.0
#: log-odds count from so many standard deviations on
SIGNIFICANT = 3.0
#: taken off every token's log-odds, so that segments end when nothing toxic follows
DRIFT = 0.5
#: up to so many words and stems with significant log-odds are broadcast; more are joined with the texts' words
BROADCAST_FEATURES = 400_000
#: a passage is significant if so few of its score are expected by chance in a clean text of the length
EXPECTED = 0.01

_WORDS = re.compile(r"[^\W\d_]+")
_COUNTS = "word string, toxic long, clean long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every word the number of toxic and of clean texts that hold it, summed in the task."""
    kinds = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        words = list(kinds[0].keys() | kinds[1].keys())
        return pa.record_batch([pa.array(words, pa.string()), pa.array([kinds[1][w] for w in words], pa.int64()),
                                pa.array([kinds[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kinds[toxic].update(set(_WORDS.findall(text.lower())))
            if len(kinds[0]) + len(kinds[1]) > 300_000:
                yield out()
                kinds = (Counter(), Counter())
    yield out()


def _log_odds(toxic: Column, clean: Column, prior: Column, base: float) -> tuple[Column, Column]:
    """Log-odds of the toxic share under a prior share of weight ``PRIOR``, against the corpus, and their error."""
    hit, miss = toxic + PRIOR * prior, clean + PRIOR * (1 - prior)
    return F.log(hit / miss) - math.log(base / (1 - base)), F.sqrt(1 / hit + 1 / miss)


@dataclass(frozen=True)
class Scores:
    """Token scores with the drift taken off; ``rate`` and ``scale`` are lambda and ln K of the extreme-value law."""

    words: dict[str, float]
    stems: dict[str, float]
    rate: float
    scale: float = 0.0
    #: logistic curve over the evidence
    offset: float = -20.0
    slope: float = 0.0

    def evalue(self, score: float, tokens: int) -> float:
        return math.exp(min(700.0, self.scale - self.rate * score)) * tokens

    def evidence(self, segments: Sequence[float], tokens: int) -> float:
        """Minus the logarithm of the chance that a clean text has segments like the best ones (sum statistic).

        Taken for the best segment, the best two and so on; the strongest counts, less the price of choosing.
        """
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(segments, reverse=True), 1):
            total += self.rate * s - self.scale - math.log(max(tokens, 1))
            t = total + math.lgamma(r + 1)
            if t <= 0:
                break
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return min(best, 100.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(min(700.0, -(self.offset + self.slope * evidence))))


class _Lookup(dict):
    """Scores of words, with those of unseen ones worked out once."""

    def __init__(self, model: Scores):
        super().__init__(model.words)
        self.stems, self.room = model.stems, 300_000

    def __missing__(self, word: str) -> float:
        score = self.stems.get(word[:STEM], -DRIFT)
        if self.room:
            self[word] = score
            self.room -= 1
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(begin, end, score)`` of a row of token scores, in one pass.

    Runs of one sign are summed first, which no maximal segment cuts.  The pass keeps the candidates with the sums
    before and after them; a new one looks back along candidates with a smaller sum before it and swallows the
    stretch since, as long as that raises the score.
    """
    up = scores > 0
    if not up.any():
        return []
    begins = np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1])
    sums = np.add.reduceat(scores, begins)
    ends = np.concatenate([begins[1:], [len(scores)]])
    found: list[list] = []  # begin, end, sum before, sum after, next candidate to look at
    total = 0.0
    for b, e, s in zip(begins.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [b, e, before, total, len(found) - 1]
        while True:
            j = new[4]
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], found[j][4]]
            del found[j:]
    return [(b, e, after - before) for b, e, before, after, _ in found]


_SCANNED = "doc_id long, tokens long, segments array<struct<begin:long,end:long,score:double>>"


def _segments(text: str | None, scores: dict[str, float]) -> tuple[int, list[dict]]:
    """The number of tokens and the maximal segments in characters; ``scores`` has or makes up one for every word."""
    low = (text or "").lower()
    words = _WORDS.findall(low)
    found = maximal_segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)))
    spans = [m.span() for m in _WORDS.finditer(low)] if found else []
    return len(words), [{"begin": spans[b][0], "end": spans[e - 1][1], "score": s} for b, e, s in found]


def _scanned(ids: pa.Array, rows: Sequence[tuple[int, list[dict]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    return pa.record_batch([ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind)], names=["doc_id", "tokens", "segments"])


def _scan(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scores = _Lookup(model.value)
    for batch in batches:
        yield _scanned(batch.column(0), [_segments(t, scores) for t in batch.column(1).to_pylist()])


def _scan_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like :func:`_scan`, for rows that carry the scores of their words; a word without one is neutral."""
    for batch in batches:
        ids, texts, words, scores = (batch.column(k) for k in range(4))
        rows = []
        for text, w, s in zip(texts.to_pylist(), words.to_pylist(), scores.to_pylist(), strict=True):
            rows.append(_segments(text, defaultdict(lambda: -DRIFT, zip(w or [], s or [], strict=True))))
        yield _scanned(ids, rows)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, a text at a time."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = list(set(_WORDS.findall(text.lower())))
            yield pa.record_batch([pa.array([key] * len(own), pa.string()), pa.array(own, pa.string())], names=["_text", "word"])


def segments(docs: DataFrame, words: DataFrame, stems: DataFrame) -> DataFrame:
    """``doc_id, tokens, segments`` of ``docs(doc_id, text)`` under ``words(word, score)`` and ``stems(stem, score)``.

    A word has its own score, else its stem's, else that of a neutral one.  As many scores as a count shows to fit are
    broadcast.  Beyond that the distinct words of each distinct text meet their scores in joins, and each text is
    scanned beside the scores of its own words; the segments are the same.
    """
    spark: SparkSession = docs.sparkSession
    bound = BROADCAST_FEATURES + 1
    if words.limit(bound).count() + stems.limit(bound).count() < bound:
        model = spark.sparkContext.broadcast(Scores(*({r[0]: r[1] for r in side.collect()} for side in (words, stems)), 1.0))
        return docs.select("doc_id", "text").mapInArrow(functools.partial(_scan, model=model), _SCANNED)
    keyed = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("_text"))
    apart = (keyed.where("text is not null").select("_text", "text").dropDuplicates(["_text"])
             .mapInArrow(_words, "_text string, word string").withColumn("stem", F.substring("word", 1, STEM)))
    own = words.withColumnRenamed("score", "_own")
    known = (apart.join(own, "word", "left").join(stems.withColumnRenamed("score", "_back"), "stem", "left")
             .select("_text", "word", F.coalesce("_own", "_back").alias("_score")).where("_score is not null"))
    sets = known.groupBy("_text").agg(F.collect_list(F.struct("word", "_score")).alias("_w"))
    return (keyed.join(sets, "_text", "left").select("doc_id", "text", F.col("_w.word").alias("_words"), F.col("_w._score").alias("_scores"))
            .mapInArrow(_scan_beside, _SCANNED))


def _evidence(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Scores = model.value
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("evalue", pa.float64())]))
    for batch in batches:
        tokens, segments = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        x = [m.evidence([s["score"] for s in own], n) for own, n in zip(segments, tokens, strict=True)]
        passages = [[{"begin": s["begin"], "end": s["end"], "evalue": v} for s in own if (v := m.evalue(s["score"], n)) <= EXPECTED]
                    for own, n in zip(segments, tokens, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(x, pa.float64()), pa.array([m.probability(v) for v in x], pa.float64()),
                               pa.array(passages, kind)], names=["doc_id", "evidence", "score", "passages"])


def _rate(weights: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * score)) = 1, for scores of negative mean."""
    p = weights / weights.sum()
    low, high = 0.0, 1.0
    while high < 64 and float(p @ np.exp(np.minimum(high * scores, 600))) < 1:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if float(p @ np.exp(np.minimum(middle * scores, 600))) < 1 else (low, middle)
    return max(low, 1e-3)


def _curve(x: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> tuple[float, float]:
    """Logistic regression on binned evidence, with one pseudo-count of either label at both ends."""
    x, hits, misses = np.append(x, [0.0, x.max(initial=1.0)]), np.append(hits, [0.5, 0.5]), np.append(misses, [0.5, 0.5])
    a, b = math.log((hits.sum()) / misses.sum()), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = (hits + misses) * p * (1 - p) + 1e-9
        g = hits - (hits + misses) * p
        m = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-6]])
        da, db = np.linalg.solve(m, [g.sum(), (g * x).sum()])
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
    return float(a), float(b)


def learn_words(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """``words(word, score)``, ``stems(stem, score)`` and the rate of the extreme-value law from ``labelled(text, toxic)``.

    Counts are of the different texts with a word, over all rows: words that one text repeats, or that come in copies
    of one text, are no evidence of their own.

    A stem's toxic share has the corpus' share as its Dirichlet prior, a word's has its stem's, so rare words lean on
    words that begin alike.  What does not differ significantly from the corpus counts as neutral.
    """
    counts = materialize(labelled.where("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int"), F.xxhash64("text").alias("_text"))
                         .dropDuplicates(["_text"]).select("text", "toxic").mapInArrow(_count, _COUNTS).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-words")
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    hits, misses = total["t"] or 0, total["c"] or 0
    if not hits or not misses:
        spark = labelled.sparkSession
        return spark.createDataFrame([], "word string, score double"), spark.createDataFrame([], "stem string, score double"), 1.0
    base = hits / (hits + misses)
    stem = F.substring("word", 1, STEM)
    stems = counts.groupBy(stem.alias("stem")).agg(F.sum("toxic").alias("_t"), F.sum("clean").alias("_c"))
    odds, error = _log_odds(F.col("_t"), F.col("_c"), F.lit(base), base)
    stems = materialize(stems.select("stem", ((F.col("_t") + PRIOR * base) / (F.col("_t") + F.col("_c") + PRIOR)).alias("_share"),
                                     F.when(F.abs(odds / error) >= SIGNIFICANT, odds).otherwise(0.0).alias("_odds")), "toxic-stems")
    odds, error = _log_odds(F.col("toxic"), F.col("clean"), F.col("_share"), base)
    words = materialize(counts.withColumn("stem", stem).join(stems, "stem").select(
        "word", "toxic", "clean", "_odds",
        F.when(F.abs(odds / error) >= SIGNIFICANT, odds).otherwise(F.col("_odds")).alias("odds")), "toxic-odds")
    own = words.where("odds <> _odds").select("word", (F.col("odds") - DRIFT).alias("score"))
    back = stems.where("_odds <> 0").select("stem", (F.col("_odds") - DRIFT).alias("score"))
    bins = words.groupBy(F.round("odds", 2).alias("odds")).agg(F.sum("clean").alias("n")).where("n > 0").toPandas()
    rate = _rate(bins["n"].to_numpy(float), bins["odds"].to_numpy(float) - DRIFT)
    return own, back, rate


def score(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Toxicity of every document: ``doc_id, score, passages``.

    Trained on ``labels(doc_id, toxic)`` of the documents where ``learn`` holds; scores see nothing but the text.  Every
    maximal segment of token log-odds is found; scores of segments in clean texts follow an extreme-value law,
    whose rate is solved from the clean tokens and whose scale is fitted to the clean training texts.  Passages
    (character ranges of the lower-cased text) are the segments rarely expected by chance, and the score is a
    logistic curve, fitted to the training texts, over the sum statistic of a document's segments.

    A null or empty text has no segment and gets the score of no evidence.  Without toxic or without clean training
    tokens nothing can be learned and all scores are those of no evidence.  Labels other than 0 and 1, and labels of absent
    documents, do not count; a repeated label counts again.  Every row of ``docs`` gives one row.
    """
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("_learn"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    words, stems, rate = learn_words(beside(slim.where("_learn").select("doc_id", "text"), marks, ["doc_id"]))
    scanned = materialize(segments(slim, words, stems), "toxic-segments")
    trained = beside(scanned.join(slim.where("_learn").select("doc_id").distinct(), "doc_id", "left_semi"), marks, ["doc_id"])
    top = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    law = trained.where("toxic = 0 and tokens > 0").agg(F.avg(rate * top - F.log("tokens")).alias("m")).first()["m"]
    fitted = Scores({}, {}, rate, (law if law is not None else 0.0) - 0.5772156649)
    evidence = functools.partial(_evidence, model=spark.sparkContext.broadcast(fitted))
    kind = "doc_id long, evidence double, score double, passages array<struct<begin:long,end:long,evalue:double>>"
    bins = (trained.select("doc_id", "tokens", "segments", "toxic").select("doc_id", "tokens", "segments").mapInArrow(evidence, kind)
            .select("doc_id", F.round(F.col("evidence") * 4).alias("bin")).distinct()
            .join(marks, "doc_id").groupBy("bin").agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("misses")).toPandas())
    offset, slope = (_curve(bins["bin"].to_numpy(float) / 4, bins["hits"].to_numpy(float), bins["misses"].to_numpy(float))
                     if len(bins) else (-20.0, 0.0))
    final = spark.sparkContext.broadcast(Scores({}, {}, fitted.rate, fitted.scale, offset, slope))
    return scanned.mapInArrow(functools.partial(_evidence, model=final), kind).select("doc_id", "score", "passages")
