"""Benchmark passages in documents, up to an edit distance, by the pigeonhole principle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: edits allowed for each character of an item
ERRORS = 0.08
#: characters of all items that one pass looks for; more items take more passes
BLOCK_CHARS = 1_000_000

_WORDS = re.compile(r"\w+")


def normal(text: str | None) -> str:
    """Lower-case words, each between single blanks; nothing if there is none."""
    words = _WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int

    @staticmethod
    def of(item_id: int, text: str | None, errors: float = ERRORS) -> Item:
        body = normal(text)
        return Item(item_id, body, int(len(body) * errors))

    def pieces(self) -> Iterator[tuple[int, str]]:
        """``budget + 1`` pieces: that many edits leave at least one of them as it is."""
        n, parts = len(self.text), self.budget + 1
        for k in range(parts):
            low, high = k * n // parts, (k + 1) * n // parts
            yield low, self.text[low:high]

    def letters(self) -> dict[str, int]:
        """For every character the set of its places, as bits."""
        table: dict[str, int] = {}
        for i, c in enumerate(self.text):
            table[c] = table.get(c, 0) | (1 << i)
        return table


def best_match(letters: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item to a part of ``text``, and where the first such part ends.

    Bit-parallel: the column differences of the distance table are two numbers of ``length`` bits.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best, end = full, 0, length, length, 0
    for j, c in enumerate(text, 1):
        equal = letters.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        if score < best:
            best, end = score, j
    return best, end


class Finder:
    """Looks for all pieces of all items at once and verifies what the hits point at."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = [i for i in items if i.text]
        self.letters = [i.letters() for i in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for at, piece in item.pieces():
                places.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, found in places.items():
            self.machine.add_word(piece, (len(piece), found))
        if places:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, begin, end)`` of the best part for every item within its budget, in the normal text.

        ``begin`` is where the item would begin without insertions or deletions before the hit.
        """
        body = normal(text)
        if not self.items or not body:
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, found) in self.machine.iter(body):
            for k, at in found:
                starts.setdefault(k, set()).add(last + 1 - size - at)
        out = []
        for k, begins in starts.items():
            item, best = self.items[k], None
            reached = None
            for start in sorted(begins):
                if reached is not None and start <= reached:
                    continue
                # one window serves all starts up to a budget further on
                reached = start + item.budget
                low, high = max(0, start - item.budget), reached + len(item.text) + item.budget
                distance, end = best_match(self.letters[k], len(item.text), body[low:high])
                if distance <= item.budget and (best is None or distance < best[0]):
                    best = (distance, max(0, low + end - len(item.text)), low + end)
                    if not distance:
                        break
            if best:
                out.append((item.item_id, *best))
        return sorted(out)


def finders(spark, benchmark: DataFrame, errors: float = ERRORS) -> list:
    """Broadcast lists of items, each of at most about ``BLOCK_CHARS`` characters, together all of them."""
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = []
    for b in range(blocks):
        own = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        out.append(spark.sparkContext.broadcast([Item.of(r["item_id"], r["text"], errors) for r in own]))
    return out


def _hits(items) -> Callable[[Column | str], Column]:
    @F.pandas_udf("array<struct<item_id:long,distance:int,begin:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(items.value)
        for texts in batches:
            yield pd.Series([finder.find(t) for t in texts], dtype=object)

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Which documents hold which benchmark items: ``doc_id, item_id, distance, begin, end``.

    Texts and items are compared as lower-case words; an item is found if a part of the text is within
    ``floor(errors * length)`` edits of it.  Each item is cut into one piece more than that, so one piece at least occurs
    exactly; the pieces of all items are looked for in one pass over the text, and every hit's surroundings are
    verified with bit-parallel edit distance.  One row per document and item, with the best part; ``begin`` and ``end`` are
    places in the normal form.

    Null, empty and wordless texts hold nothing, such items are held by nothing; items without errors to allow must
    occur as they are.  Rows with the same id give a row each.  An empty table on either side gives none.
    """
    slim, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for items in finders(docs.sparkSession, benchmark, errors):
        found = slim.select("doc_id", F.explode(_hits(items)("text")).alias("hit")).select("doc_id", "hit.*")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The documents that hold no benchmark item, as they are."""
    for items in finders(docs.sparkSession, benchmark, errors):
        docs = docs.where(F.size(_hits(items)("text")) == 0)
    return docs
