"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmergrid.llm.common import frugal, groups_of, slices_of, small
from kmergrid.session import materialize

#: words of a shingle, and the similarity of a link in per cent
SHINGLE = 5
PERCENT = 85
#: a pair at the threshold shares no band with probability (1 - 0.85 ** 5) ** 32, about 7 in a billion, one at 0.8 with
#: about 3 in a million
BANDS, ROWS = 32, 5
#: places that the two permutations act on
PLACES = 1 << 22
#: buckets of at most so many members have all their pairs compared at once
SMALL_BUCKET = 8
#: a hub to which at least this share of its members is linked leaves the others to a new hub of their own
STAR = 1 / 16
#: fewer unlinked members than this stay with their hub: each of them meets no more others than that
FAMILY = 64

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingles(texts: Sequence[str]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles, by running sums over the bytes of all texts."""
    data = b" ".join([b"", *(t.encode().translate(_UPPER) for t in texts), b""])
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = _powers(1 << (max(len(raw), 1 << 16) - 1).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_bytes()[raw] * up[:len(raw)])])
    words = _mix((sums[end] - sums[begin]) * down[begin])
    ends = np.cumsum([1 + len(t.encode()) for t in texts]) if not data.isascii() else np.cumsum([1 + len(t) for t in texts])
    limits = np.searchsorted(begin, ends)
    window = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        window = _mix(window + words[k:k + len(window)] + np.uint64(k + 1))
    out, low = [], 0
    for high in limits.tolist():
        if high - low >= SHINGLE:
            out.append(np.unique(window[low:high - SHINGLE + 1]))
        elif high > low:
            short = np.array([high - low], np.uint64)
            for w in words[low:high]:
                short = _mix(short * np.uint64(_ODD) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        low = high
    return out


@functools.lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one wound on so that every shift of it is a slice."""
    rng = np.random.default_rng(7)
    first, second = (rng.permutation(PLACES).astype(np.uint32) for _ in range(2))
    return first, np.concatenate([second, second[:BANDS * ROWS]])


def signature(found: np.ndarray) -> np.ndarray:
    """Coordinate ``k`` is the least value of the second permutation, shifted by ``k``, over the places of the set."""
    first, second = permutations()
    places = first[(found >> np.uint64(42)).astype(np.int64)]
    shifts = sliding_window_view(second, BANDS * ROWS)
    least = np.full(BANDS * ROWS, PLACES, np.uint32)
    for k in range(0, len(places), 4096):
        least = np.minimum(least, shifts[places[k:k + 4096]].min(axis=0))
    return least


def bands(found: np.ndarray) -> np.ndarray:
    table = signature(found).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_ODD)
    for k in range(ROWS):
        key = _mix(key + table[:, k])
    return key


_FEATURES = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"


def _forget() -> None:
    _powers.cache_clear()
    permutations.cache_clear()


@frugal(_forget)
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices_of(whole, 2)):
        sets = shingles([t or "" for t in batch.column(2).to_pylist()])
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        cut = [bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                               pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cut), pa.int64()))],
                              names=["doc_id", "text_key", "n_shingles", "set_key", "bands"])


@frugal(_forget)
def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar; a hub's rows mostly come together, so its set is kept for the next row."""
    text, other = None, None
    for batch in batches:
        ids_a, ids_b, texts_a, texts_b = (c.to_pylist() for c in batch.columns)
        left, right = [], []
        for low, high in groups_of(texts_a):
            for k, one in enumerate(shingles(texts_a[low:high]), low):
                if text != texts_b[k]:
                    text = texts_b[k]
                    other = shingles([text])[0]
                both = len(np.intersect1d(one, other, assume_unique=True))
                if both and 100 * both >= percent * (len(one) + len(other) - both):
                    left.append(ids_a[k])
                    right.append(ids_b[k])
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links(a, b)``: the smallest id that each reaches.

    Every round lets a component hook onto its smallest neighbour, follows these pointers to their roots by doubling
    and joins the links with the new names, until no link leads from one component to another.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")), "hooks")
        while True:
            once = _follow(hooks, small(hooks))
            ahead = small(once).select(F.col("a").alias("_at"), F.col("to").alias("_to"))
            twice = materialize(once.join(ahead, once["to"] == F.col("_at"), "left").select("a", "to", F.coalesce("_to", "to").alias("far")), "jumps")
            hooks = twice.select("a", F.col("far").alias("to"))
            if twice.where("far <> to").isEmpty():
                break
        pointers = small(hooks)
        labels = _follow(labels.withColumnsRenamed({"node": "a", "component": "to"}), pointers).toDF("node", "component")
        named = edges.join(pointers, "a").select("b", F.col("to").alias("x")).join(pointers.withColumnRenamed("a", "b"), "b")
        edges = materialize(named.where("x <> to").select(F.col("x").alias("a"), F.col("to").alias("b")).distinct(), "edges")
    return materialize(labels, "labels")


def _follow(pointers: DataFrame, further: DataFrame) -> DataFrame:
    """``a, to`` one step further on; ``to`` stays where ``further(a, to)`` does not list it."""
    ahead = further.select(F.col("a").alias("_at"), F.col("to").alias("_to"))
    return pointers.join(ahead, pointers["to"] == F.col("_at"), "left").select("a", F.coalesce("_to", "to").alias("to"))


@frugal(_forget)
def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For a hub and a member of its bucket: whether they are linked, and the shingles that only one of them has."""
    kind = pa.schema([("hub", pa.int64()), ("rep", pa.int64()), ("n_hub", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("apart", pa.list_(pa.int64()))])
    text, other = None, None
    for batch in batches:
        hubs, reps, texts_h, texts = (c.to_pylist() for c in batch.columns)
        for low, high in groups_of(texts):
            rows = []
            for k, one in enumerate(shingles(texts[low:high]), low):
                if text != texts_h[k]:
                    text = texts_h[k]
                    other = shingles([text])[0]
                apart = np.setxor1d(one, other, assume_unique=True)
                both = (len(one) + len(other) - len(apart)) // 2
                rows.append((hubs[k], reps[k], len(other), len(one), 100 * both >= percent * (both + len(apart)), apart.view(np.int64)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def _beyond_hubs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of members of a hub that may be linked although ``a`` is not linked to the hub.

    With D the shingles in which a member differs from the hub, two members are linked if their D differ in at most
    ``t * (n_i + n_j)`` places, t = (100 - percent) / (100 + percent).  With m the least ``|D_i| - t * n_i`` of all ``i`` that are
    not linked to the hub (more than ``t * n_hub``), at least ``(|D_j| - t * n_j + m) / 2`` of D_j must lie in D_i, and, as
    D_j cannot be much smaller, all of D_i but ``t * (n_i + n_j)``.  The first common member in any order is then among
    the first few of both.  Rare shingles come first, so that pairs with nothing but the hub's text in common do not meet.

    A hub marked ``goes_on`` leaves pairs of two unlinked members to a later hub; only linked members are indexed for
    it, and nobody asks whose D is larger than any of theirs can explain.
    """
    t = (100 - percent) / (100 + percent)
    sized = apart.withColumn("s", F.size("apart")).withColumn("indexed", F.col("linked") | ~F.col("goes_on"))
    most, least_of = F.max(F.when(F.col("indexed"), F.col("s") + t * F.col("n"))), F.min(F.when(~F.col("linked"), F.col("s") - t * F.col("n")))
    bounds = sized.groupBy("hub").agg(most.alias("most"), least_of.alias("least"))
    met = sized.join(small(materialize(bounds.where("most >= least - 1e-6"), "bounds")), "hub")
    groups = met.where((F.col("indexed") & (F.col("s") + t * F.col("n") >= F.col("least") - 1e-6))
                       | (~F.col("linked") & (F.col("s") - t * F.col("n") <= F.col("most") + 1e-6))).drop("most")
    places = groups.select("hub", "rep", F.explode("apart").alias("x"))
    often = places.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("f"))
    ordered = (places.join(often, ["hub", "x"]).groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("f", "x")))["x"].alias("x"))
               .join(groups.select("hub", "rep", "n", "s", "linked", "indexed", F.col("least").alias("m")), ["hub", "rep"]))
    ordered = materialize(ordered, "differences")
    least = F.ceil((F.col("s") - t * F.col("n") + F.col("m")) / 2 - 1e-6)
    index = ordered.where("indexed").select(
        "hub", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"),
        F.posexplode(F.slice("x", F.lit(1), F.greatest(F.lit(1), F.col("s") - least + 1).cast("int"))).alias("at_b", "x"))
    reach = F.floor(t * F.col("n") * (1 + 100 / percent) + 1e-9) + 1
    probe = ordered.where(~F.col("linked")).select("hub", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"),
                                                   F.posexplode(F.slice("x", F.lit(1), reach.cast("int"))).alias("at_a", "x"))
    # at the first common place both must have as many more as the pair needs in common
    needed = (F.col("s_a") + F.col("s_b") - t * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-9
    left = F.least(F.col("s_a") - F.col("at_a"), F.col("s_b") - F.col("at_b"))
    return probe.join(index, ["hub", "x"]).where((F.col("a") != F.col("b")) & (left >= needed)).select("a", "n_a", "b", "n_b")


def _common_hubs(spokes: DataFrame) -> DataFrame:
    """``hub, to``: for hubs of which half the members at least also lie under a larger hub ``to``, that one.

    Any text can stand for a hub in :func:`_beyond_hubs`, so members of several hubs need their differences from one only.
    A larger hub has at most twice the shingles, as what it has and the members don't is in their differences too.  Pointers are
    followed for one step; a hub that is still not at an end keeps its members.
    """
    sized = spokes.join(small(spokes.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"))), "hub").select("hub", "rep", "n_hub", "rows")
    top = sized.groupBy("rep").agg(F.max(F.struct("rows", "hub", "n_hub")).alias("top"))
    met = sized.join(top, "rep").where("hub <> top.hub and top.n_hub <= 2 * n_hub")
    best = (met.groupBy("hub", "rows", F.col("top.hub").alias("to")).agg(F.count(F.lit(1)).alias("both")).where("2 * both >= rows")
            .groupBy("hub").agg(F.max_by("to", F.struct("both", "to")).alias("to")))
    best = materialize(best, "common_hubs").withColumnRenamed("hub", "a")
    ends = _follow(best, small(best)).join(small(best.select(F.col("a").alias("to"))), "to", "left_anti")
    return ends.select(F.col("a").alias("hub"), "to")


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """Each pair once, without those whose sizes differ too much for a link."""
    return (pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(1).alias("_")).select("a", "b"))


def _links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b``: confirmed links that hold together whatever is linked among the ``members`` of common buckets.

    Every round takes the pairs of small buckets, and for a large bucket the member that shares most buckets as its hub.
    Members linked to a hub are done with each other; pairs of a linked and an unlinked one, or all further pairs where
    hardly anybody is linked, come from :func:`_beyond_hubs`; hubs of the latter kind that share members do so by one of
    them (:func:`_common_hubs`).  The unlinked members of the other hubs are the next
    round's buckets, smaller by a sixteenth at least, so that each family of near copies gets a hub of its own.
    """
    def beside(pairs: DataFrame, a: str, b: str) -> DataFrame:
        for c in (a, b):
            pairs = pairs.join(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)
        return pairs.select(a, b, f"text_{a}", f"text_{b}")

    def compared(spokes: DataFrame) -> DataFrame:
        return materialize(beside(spokes, "rep", "hub").select("hub", "rep", "text_hub", "text_rep").mapInArrow(
            functools.partial(_differences, percent=percent), "hub long, rep long, n_hub long, n long, linked boolean, apart array<long>"), "spokes")

    near, stars = [], []
    while True:
        few = members.where(F.col("size") <= SMALL_BUCKET)
        one = few.select("bucket", F.col("rep").alias("a"), F.col("n").alias("n_a"))
        other = few.select("bucket", F.col("rep").alias("b"), F.col("n").alias("n_b"))
        near.append(_candidates(one.join(other, "bucket").where("a < b").select("a", "n_a", "b", "n_b"), percent))
        large = members.where(F.col("size") > SMALL_BUCKET)
        central = large.groupBy("rep").agg(F.sum("size").alias("score"))
        hubs = large.join(central, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("score", "rep")).alias("hub"))
        beside_hub = materialize(large.join(hubs, "bucket").where("rep <> hub"), "beside_hub")
        spokes = beside_hub.select("hub", "rep").distinct()
        apart = compared(spokes)
        told = beside_hub.drop("size").join(apart.select("hub", "rep", "linked"), ["hub", "rep"])
        star, left = F.avg(F.col("linked").cast("int")) >= STAR, F.countDistinct(F.when(~F.col("linked"), F.col("rep"))) >= FAMILY
        share = materialize(told.groupBy("hub").agg((star & left).alias("goes_on"), (~star).alias("lone")), "shares")
        apart = apart.join(small(share), "hub")
        stars.append(apart.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
        moves = _common_hubs(apart.where("lone"))
        if not moves.isEmpty():
            moved = apart.join(small(moves), "hub").select(F.col("to").alias("hub"), "rep").where("hub <> rep").distinct()
            more = compared(moved.join(apart.select("hub", "rep"), ["hub", "rep"], "left_anti"))
            stars.append(more.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
            stay = apart.join(small(moves), "hub", "left_anti").drop("lone")
            apart = stay.unionByName(more.withColumn("goes_on", F.lit(False)))
        near.append(_candidates(_beyond_hubs(apart, percent), percent))
        rest = told.where(~F.col("linked")).join(small(share.where("goes_on")), "hub").select("bucket", "rep", "n")
        sizes = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = materialize(rest.join(sizes, "bucket"), "members")
        if members.isEmpty():
            break
    pairs = functools.reduce(DataFrame.unionByName, near).distinct()
    links = materialize(beside(pairs, "a", "b").mapInArrow(functools.partial(_verify, percent=percent), "a long, b long"), "links")
    return functools.reduce(DataFrame.unionByName, stars, links)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.

    Documents with ``100 * |A n B| >= percent * |A u B|`` over their sets of distinct five-word shingles are linked;
    ``component_id`` is the smallest id reachable over links, ``kept`` marks documents that have it themselves.

    Documents with equal sets form a class, of which the smallest id goes on alone.  Its signature (two permutations, the
    second shifted along) is cut into bands.  Pairs in a common bucket are candidates, and links are confirmed on full
    sets.  All pairs of a small bucket are compared; in a larger one everybody with a hub, the member that shares most
    buckets with others.  Members linked to the hub are in one component; the others get hubs of their own in further
    rounds (:func:`_links`), and :func:`_beyond_hubs` finds every member that can still be linked to them, so no link
    between components is lost and no family of near copies is compared pair by pair.

    A null or blank text has no shingles and is linked with nothing; one of fewer than five words has its whole
    sequence.  Rows that share an id are told apart by their texts: each belongs to its own text's component.  Rows
    without an id stand for themselves, with a null ``component_id``, and are kept.  An empty table gives an empty result.
    """
    labelled = _labelled(docs, percent)
    return labelled.select("doc_id", "n_shingles", "component_id", "kept")


def _text_key() -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """:func:`near_duplicates` with ``text_key``.  Nodes are the classes of equal sets, by numbers of their own."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
    features = materialize(given.mapInArrow(_features, _FEATURES), "minhash")
    first = F.min(F.struct("doc_id", "text_key")).alias("o")
    classes = features.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(first)
    classes = materialize(classes.select("set_key", F.col("o.doc_id").alias("first_id"), F.col("o.text_key").alias("first_key"), F.monotonically_increasing_id().alias("rep")), "classes")
    leaders = features.join(classes, "set_key").where("doc_id = first_id and text_key = first_key").dropDuplicates(["rep"])
    rows = leaders.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    members = materialize(rows.join(shared.select("bucket", "size"), "bucket"), "members")
    ids = members.select("rep").distinct().join(classes, "rep").select("rep", F.col("first_id").alias("doc_id"), F.col("first_key").alias("text_key"))
    texts = given.where(F.col("text").isNotNull()).join(ids, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    texts = materialize(texts.select(F.col("rep").alias("doc_id"), "text"), "texts")

    links = _links(members, texts, percent)
    labels = materialize(components(links).join(classes.select(F.col("rep").alias("node"), "first_id"), "node"), "labels")
    least = labels.groupBy("component").agg(F.min("first_id").alias("least"))
    named = labels.join(least, "component").select(F.col("node").alias("rep"), "least")
    placed = features.select("doc_id", "text_key", "n_shingles", "set_key").join(classes, "set_key", "left").join(named, "rep", "left")
    mine = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("least", "first_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "text_key", "n_shingles", mine.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which one of each group is kept, as they are; rows without an id all stay.

    Of rows that share an id each goes or stays by its own text; rows that share both id and text do so together.
    """
    gone = _labelled(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    met = (docs["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__key"))
    return docs.join(gone, met, "left_anti").select(*docs.columns)
