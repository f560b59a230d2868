"""Mixing sources to target weights with blocks, shard draws and index permutations."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmergrid.llm.common import WORD, frugal, running, unit_hash
from kmergrid.session import materialize

#: weights of the sources in code point order, repeated as often as needed
WEIGHTS = (3, 1, 2)
#: words of a block, and blocks of an output shard
BLOCK = 256
SHARD_BLOCKS = 1024
#: slots that are drawn one after the other at the end of a draw
DRAWN_SINGLY = 32


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Words each source gives: ``total`` by weight, none above ``most`` times its size, the excess shared again."""
    result = [0.0] * len(sizes)
    left, open_ = float(total), [i for i, s in enumerate(sizes) if s]
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                result[i] = share * weights[i]
            break
        for i in full:
            result[i] = most * sizes[i]
            left -= result[i]
        open_ = [i for i in open_ if i not in set(full)]
    return result


def _mix64(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A pseudorandom permutation of ``range(n)``: four Feistel rounds, walked until the value falls inside."""

    n: int
    key: int

    def _step(self, x: np.ndarray, rounds: Sequence[int]) -> np.ndarray:
        half = np.uint64(max(1, (max(self.n - 1, 1).bit_length() + 1) // 2))
        mask = np.uint64((1 << int(half)) - 1)
        left, right = x >> half, x & mask
        forward = rounds[0] == 0
        for k in rounds:
            if forward:
                left, right = right, left ^ (_mix64(right, (self.key * 8 + k) & (2**63 - 1)) & mask)
            else:
                left, right = right ^ (_mix64(left, (self.key * 8 + k) & (2**63 - 1)) & mask), left
        return (left << half) | right

    def _walk(self, index: np.ndarray, rounds: Sequence[int]) -> np.ndarray:
        x = self._step(np.asarray(index, np.uint64), rounds)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._step(x[out], rounds)
        return x.astype(np.int64)

    def at(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, (0, 1, 2, 3))

    def where(self, value: np.ndarray) -> np.ndarray:
        return self._walk(value, (3, 2, 1, 0))


@dataclass(frozen=True)
class Stream:
    """The blocks of one source and the words the mix takes of them; slot ``i`` reads block ``order.at(i mod n)``."""

    words: int
    take: int
    block: int
    order: Permutation

    @property
    def n(self) -> int:
        return self.order.n

    def before(self, slot: np.ndarray) -> np.ndarray:
        """Words of all slots before ``slot``; only the last block of the stream is short."""
        if not self.n:
            return np.zeros(len(slot), np.int64)
        short = int(self.order.where(np.array([self.n - 1]))[0])
        lap, i = np.divmod(np.asarray(slot, np.int64), self.n)
        return lap * self.words + i * self.block - (self.n * self.block - self.words) * (i > short)

    @property
    def slots(self) -> int:
        if not self.take:
            return 0
        guess = np.arange(max(0, self.take // self.block - 2), self.take // self.block + 5, dtype=np.int64)
        return int(guess[self.before(guess) >= self.take][0])


def _draw(counts: np.ndarray, some: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``some`` slots fall to each source, drawn without replacement from ``counts``.

    Every slot is taken with the same chance, which makes a binomial number of each source.  All sets of as many slots are
    equally likely then, so that what is too much is drawn from those taken and what is missing from those left, in the
    same way; each time about the square root of the number is open.  The last few are drawn one by one.
    """
    counts = counts.astype(np.int64)
    left, total = int(some), int(counts.sum())
    if left <= DRAWN_SINGLY:
        out = np.zeros_like(counts)
        for k in range(left):
            i = int(np.searchsorted(np.cumsum(counts - out), rng.integers(total - k), side="right"))
            out[i] += 1
        return out
    out = rng.binomial(counts, left / total)
    over = int(out.sum()) - left
    return out - _draw(out, over, rng) if over > 0 else out + _draw(counts - out, -over, rng)


def shard_counts(counts: tuple[int, ...], shard_blocks: int, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before ``shard`` and in it.

    Every shard's counts are multinomial given the totals of the whole mix: the shards are halved again and again,
    and each halving draws, with a seed of its own, what goes to the left.  Any task gets the same numbers for a shard.
    """
    total = sum(counts)
    low, high = 0, max(1, -(-total // shard_blocks))
    before, inside = np.zeros(len(counts), np.int64), np.array(counts, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        some = min(middle * shard_blocks, total) - low * shard_blocks
        left = _draw(inside, some, np.random.default_rng([seed, low, high]))
        if shard < middle:
            inside, high = left, middle
        else:
            before, inside, low = before + left, inside - left, middle
    return before, inside


@frugal()
def _slots(batches: Iterator[pd.DataFrame], streams: list[Stream], shard_blocks: int, seed: int) -> Iterator[pd.DataFrame]:
    counts = tuple(s.slots for s in streams)
    for batch in batches:
        for k in batch["id"]:
            before, inside = shard_counts(counts, shard_blocks, seed, int(k))
            parts = []
            for j in np.flatnonzero(inside):
                s, slot = streams[j], before[j] + np.arange(inside[j], dtype=np.int64)
                words = np.minimum(s.before(slot + 1), s.take) - s.before(slot)
                parts.append(pd.DataFrame({"_stream": j, "_block": s.order.at(slot % s.n), "_lap": slot // s.n, "_words": words}))
            if parts:
                out = pd.concat(parts, ignore_index=True)
                out["slot"] = np.random.default_rng([seed, 1, int(k)]).permutation(len(out))
                out["shard"] = k
                yield out.astype({"_stream": "int32", "_block": "int64", "_lap": "int32", "_words": "int32", "slot": "int64", "shard": "int64"})


@dataclass
class Mix:
    #: doc_id, source, size, source_size, target of every document
    documents: DataFrame
    #: doc_id, _from, _to (words of the document), shard, slot, _lap of every piece that the mix takes
    pieces: DataFrame


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, block: int = BLOCK,
        shard_blocks: int = SHARD_BLOCKS, seed: int = 20) -> Mix:
    """Draw ``share`` times all words from the sources, by weight.

    The words of a source, documents in the order of a seeded hash, form a stream of blocks of ``block`` words.  Each
    output shard of ``shard_blocks`` slots draws how many slots each source fills; the ``i``-th slot of a source reads
    the block that the source's permutation puts at ``i``, so a block comes back only when all others have come.
    Blocks and slots meet in a join on (source, block).  The last slot of a source takes just the words still owed.

    Plain multinomial draws of many shards stray from the target and would break the limit of two passes, so they
    are drawn given the totals (see :func:`shard_counts`).

    The list of sources with their sizes is read to the driver: a mixture is a weight for each of them.  A null text has
    size 0; sources go by code point, null last.  Documents without words are never taken.  Rows with one ``doc_id``
    are separate here and come together in the results.  An empty table gives empty results.
    """
    slim = materialize(docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("_tie"),
        unit_hash(str(seed), F.col("doc_id")).alias("_u")), "mix-rows")
    found = sorted(slim.groupBy("_source").agg(F.sum("size").alias("words")).collect(), key=lambda r: (r[0] == "", r[0]))
    sizes = [r["words"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    streams = [Stream(n, min(round(t), int(2 * n)), block, Permutation(-(-n // block), seed * 1000003 + i))
               for i, (n, t) in enumerate(zip(sizes, aims, strict=True))]
    spark = docs.sparkSession
    listed = spark.createDataFrame([(r["_source"], i, n, t) for i, (r, n, t) in enumerate(zip(found, sizes, aims, strict=True))],
                                   "_source string, _stream int, source_size long, target double")
    placed = running(slim, "_source", "_u", ["doc_id", "_tie"], "size").join(listed, "_source")
    placed = materialize(placed.select("doc_id", "source", "size", "source_size", "target", "_stream", "_before"), "mix-offsets")

    begin, end = F.col("_before"), F.col("_before") + F.col("size")
    first = F.col("_block") * block
    parts = (placed.where("size > 0")
             .withColumn("_block", F.explode(F.sequence(F.floor(begin / block), F.floor((end - 1) / block))))
             .select("doc_id", "_stream", "_block", (first - begin).alias("_at"),
                     (F.greatest(begin, first) - first).alias("_low"), (F.least(end, first + block) - first).alias("_high")))
    total = sum(s.slots for s in streams)
    shards = -(-total // shard_blocks)
    slots = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(
        functools.partial(_slots, streams=streams, shard_blocks=shard_blocks, seed=seed),
        "_stream int, _block long, _lap int, _words int, slot long, shard long")
    high = F.least(F.col("_high"), F.col("_words"))
    # the planner sizes the slots like the shard numbers they come from, and would broadcast them
    pieces = (parts.join(slots.hint("merge"), ["_stream", "_block"]).where(high > F.col("_low"))
              .select("doc_id", (F.col("_low") + F.col("_at")).alias("_from"), (high + F.col("_at")).alias("_to"), "shard", "slot", "_lap"))
    return Mix(placed, pieces)


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``, the last in words with repeats counted.

    Rows that share an id each get the words taken of all of them, at most twice the sum of their sizes.
    """
    m = mix(docs, **options)
    words = m.pieces.groupBy("doc_id").agg(F.sum(F.col("_to") - F.col("_from")).alias("taken"))
    ids, drawn = m.documents, words.withColumnRenamed("doc_id", "_id")
    return (ids.join(drawn, ids["doc_id"].eqNullSafe(drawn["_id"]), "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


_WORD = re.compile(WORD)


def _cut(texts: pd.Series, pieces: pd.Series) -> pd.Series:
    """The taken parts of each text: a lap that takes everything gives the text as it is, others give their runs of words."""
    out = []
    for text, ranges in zip(texts, pieces, strict=True):
        spans, laps = None, {}
        for r in sorted(((p["_lap"], p["_from"], p["_to"]) for p in ranges)):
            runs = laps.setdefault(r[0], [])
            if runs and runs[-1][1] == r[1]:
                runs[-1][1] = r[2]
            else:
                runs.append([r[1], r[2]])
        parts = []
        for runs in laps.values():
            spans = spans or [m.span() for m in _WORD.finditer(text)]
            if runs == [[0, len(spans)]]:
                parts.append(text)
            else:
                parts += [text[spans[a][0]:spans[min(b, len(spans)) - 1][1]] for a, b in runs if a < len(spans)]
        out.append("\n".join(parts))
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs`` that every table of documents has.

    A document taken once in full keeps its text; one taken in part keeps those words; words taken twice stand in the text
    twice, after a line feed.  Documents of which nothing is taken are left out.  Rows that share an id each show the
    pieces drawn for all of them, as far as their words reach.
    """
    m = mix(docs, **options)
    ranges = (m.pieces.groupBy("doc_id").agg(F.collect_list(F.struct("_lap", "_from", "_to")).alias("_pieces"))
              .withColumnRenamed("doc_id", "_id"))
    whole = docs.select("doc_id", "text", "lang", "source")
    cut = F.pandas_udf(_cut, "string")
    return (whole.join(ranges, whole["doc_id"].eqNullSafe(ranges["_id"]))
            .withColumn("text", cut("text", "_pieces"))
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))
