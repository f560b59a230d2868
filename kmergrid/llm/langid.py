"""Language identification with bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmergrid.llm.common import frugal, groups_of, slices_of
from kmergrid.session import materialize

#: characters of a gram
GRAM = 3
#: a gram enters a language's filter if at least this share of the language's grams is it, so a filter has at most
#: 1 / RATE members, and if no other language uses it more than RATIO times as often
RATE = 2e-5
RATIO = 8.0
#: probes of a filter, and filter bits for each member
PROBES = 4
BITS = 12

#: characters of one pass over the text
CHUNK = 1 << 19
_GAP = re.compile(r"[\W\d_]")


@functools.lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """For every code point its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: Sequence[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams (three characters or more), and for each the number of its text.

    What is no letter counts as a gap, also the ends of a text; grams do not reach over a gap.
    """
    joined = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _lower()[joined]
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.zeros(len(points), np.int64)
    starts = 1 + np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]) if len(lengths) else np.zeros(0, np.int64)
    owner[starts] = 1
    owner = np.maximum(np.cumsum(owner) - 1, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points, owner = points[keep].astype(np.uint64), owner[keep]
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        code = (code << np.uint64(21)) ^ points[k:len(points) - n + 1 + k]
    inner = np.ones(len(code), bool)  # of the characters of a gram only the first and the last may be a gap
    for k in range(1, n - 1):
        inner &= points[k:k + len(code)] != 32
    return _mix(code[inner]), owner[1:1 + len(code)][inner]


def pieces(text: str) -> list[str]:
    """A text in parts of bounded length, cut at the next gap, across which no gram reaches."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        gap = _GAP.search(text, at + CHUNK)
        if not gap:
            break
        out.append(text[at:gap.start()])
        at = gap.end()
    return [*out, text[at:]]


@frugal()
def _count(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of grams per language, summed up in the task before they leave it."""
    kind = pa.schema([("_lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    place = {x: i for i, x in enumerate(names)}
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

    def out(lang: int) -> pa.RecordBatch:
        codes, n = merged(held.pop(lang))
        return pa.record_batch([pa.array(np.full(len(codes), lang, np.int32)), pa.array(codes.view(np.int64)), pa.array(n)], schema=kind)

    for batch in (part for whole in batches for part in slices_of(whole, 1, 1 << 23)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(langs)), key=lambda i: langs[i])
        parts = [(place[langs[i]], p) for i in order for p in pieces(texts[i])]
        for a, b in groups_of([p for _, p in parts], CHUNK):
            for lang in {x for x, _ in parts[a:b]}:
                codes, n = np.unique(grams([p for x, p in parts[a:b] if x == lang])[0], return_counts=True)
                own = held.setdefault(lang, [])
                own.append((codes, n))
                if len(own) == 16:
                    held[lang] = [merged(own)]
                    if len(held[lang][0][0]) > 500_000:
                        yield out(lang)
    for lang in list(held):
        yield out(lang)


@dataclass(frozen=True)
class Filters:
    """Row ``p`` holds bit ``p`` of all languages' filters; one bit per language, 64 in a word."""

    languages: list[str]
    rows: np.ndarray
    #: false positive rate of each filter, from its fill
    false: np.ndarray

    @staticmethod
    def build(languages: list[str], members: dict[int, np.ndarray]) -> Filters:
        most = max([1, *(len(m) for m in members.values())])
        size = 1 << (most * BITS - 1).bit_length()
        rows = np.zeros((size, -(-max(1, len(languages)) // 64)), np.uint64)
        for lang, codes in members.items():
            for k in range(PROBES):
                p = Filters.probe(codes, k, size)
                rows[p, lang // 64] |= np.uint64(1 << (lang % 64))
        fill = np.array([((rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return Filters(languages, rows, fill ** PROBES)

    @staticmethod
    def probe(codes: np.ndarray, k: int, size: int) -> np.ndarray:
        """The ``k``-th place of each gram: steps of an odd width that the gram decides."""
        step = (codes >> np.uint64(32)) | np.uint64(1)
        return ((codes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """The languages that contain each gram, as words of bits."""
        found = self.rows[self.probe(codes, 0, len(self.rows))]
        for k in range(1, PROBES):
            found = found & self.rows[self.probe(codes, k, len(self.rows))]
        return found

    def counts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and how many of them each language contains."""
        codes, owner = grams(texts)
        found = self.masks(codes)
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        for i in range(len(self.languages)):
            bit = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(owner[bit.astype(bool)], minlength=len(texts))[:len(texts)]
        return np.bincount(owner, minlength=len(texts))[:len(texts)], hits

    def decide(self, total: np.ndarray, hits: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language with the largest share of grams after taking off the expected false hits, and how clearly.

        The score is the share of the winner, times what it leads the second by, relative to itself, brought to 1/2 .. 1.
        """
        n = np.maximum(total, 1)[:, None]
        share = np.clip((hits / n - self.false) / (1 - self.false), 0, 1)
        if not len(self.languages):
            return ["und"] * len(total), np.zeros(len(total))
        best = share.argmax(axis=1)
        rows = np.arange(len(total))
        top = share[rows, best]
        rest = share.copy()
        rest[rows, best] = 0
        lead = np.where(top > 0, 1 - rest.max(axis=1) / np.maximum(top, 1e-12), 0)
        names = [self.languages[b] if t else "und" for b, t in zip(best, total, strict=True)]
        return names, np.where(total > 0, top * (0.5 + 0.5 * lead), 0.0)


def learn(docs: DataFrame) -> Filters:
    """Fit the filters to all documents with a language and a text.

    Gram counts are summed in the tasks and then by Spark.  A filter gets the grams of at least ``RATE`` in its
    language that are not ``RATIO`` times rarer there than elsewhere; that drops what stray labels and quotations
    bring in.  Only those, at most ``1 / RATE`` for each language, come to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    counted = (known.mapInArrow(functools.partial(_count, names=languages), "_lang int, gram long, n long")
               .groupBy("_lang", "gram").agg(F.sum("n").alias("n")))
    counted = materialize(counted, "gram-counts")
    totals = counted.groupBy("_lang").agg(F.sum("n").alias("total"))
    often = (counted.join(F.broadcast(totals), "_lang").withColumn("rate", F.col("n") / F.col("total"))
             .where(F.col("rate") >= RATE))
    top = F.max("rate").over(Window.partitionBy("gram"))
    kept = often.withColumn("top", top).where(F.col("rate") * RATIO >= F.col("top")).select("_lang", "gram").toPandas()
    members = {int(k): g["gram"].to_numpy().view(np.uint64) for k, g in kept.groupby("_lang")}
    return Filters.build(languages, members)


#: documents whose score is surely lower are in no known language: lower even at the upper end of an interval of so many
#: standard deviations, which widens as a text gets shorter
LEAST, SURE = 0.2, 3.0


def _decided(filters: Filters, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and numbers of grams."""
    owners, parts = [], []
    for i, t in enumerate(texts):
        own = pieces(t or "")
        parts += own
        owners += [i] * len(own)
    total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(filters.languages)), np.int64)
    for a, b in groups_of(parts, CHUNK):
        n, h = filters.counts(parts[a:b])
        np.add.at(total, owners[a:b], n)
        np.add.at(hits, owners[a:b], h)
    return *filters.decide(total, hits), total


def _at_most(share: float, n: int) -> float:
    """The upper end of Wilson's interval for a share seen in ``n`` grams."""
    z = SURE * SURE / n
    return (share + z / 2 + SURE * math.sqrt(share * (1 - share) / n + z / (4 * n))) / (1 + z)


def accepted(docs: DataFrame, filters: Filters, least: float = LEAST) -> DataFrame:
    """The documents in one of the known languages, as they are; ``und`` and texts that are surely unclear go."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        names, score, total = _decided(model.value, list(texts))
        return pd.Series([n != "und" and _at_most(s, k) >= least for n, s, k in zip(names, score, total.tolist(), strict=True)], dtype=bool)

    return docs.where(known("text"))


@frugal()
def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    filters: Filters = model.value
    for batch in batches:
        names, score, _ = _decided(filters, batch.column(1).to_pylist())
        yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                              names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """The language of every text: ``doc_id, lang_pred, score``.

    Each gram of a text yields the set of languages that contain it; the sets are added up per language, the expected
    number of false hits taken off, and the largest share wins, ties to the first language by code point.  ``und`` with score 0
    stands for texts without a letter and null ones.  A letter is what Unicode calls one.  Every row gives one row.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_predict, model=model),
                                                    "doc_id long, lang_pred string, score double")
