"""All-pairs sketch distances.

A distance matrix has a value for every pair of samples, so the work is laid
out on a grid: samples are hashed into blocks of about ``BLOCK`` sketches and
each unordered pair of blocks is one cell.  Blocks are written once and cells
read them (a product of files), so that the disk holds every sketch once and
not once per block; a cell holds at most two blocks of at most ``s`` hashes
each, whatever the data looks like.  With many blocks, hashes that only one
sample has stay behind: they shift ranks but are never shared, so the ranks of
the others are enough.  Joining sketches on their hashes instead would emit
every pair of samples for every hash they share, which for related samples is
``s`` rows per pair.

Inside a cell the pairs are computed from sorted hashes with the rank
identity of bottom-s sketches: a shared hash has rank
``rank_x + rank_y - (shared hashes up to it)`` in the union, and counts when
that rank is within the union's first ``min(|x|, |y|)``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DistanceConfig
from ..functions import numeric
from ..session import materialize

#: sketches per block at the default sketch size (100,000 hashes of 4 bytes: 51 MB)
BLOCK = 128
#: hashes a block should hold at most when sketches are smaller than the default
BLOCK_HASHES = 12_800_000
MAX_BLOCK = 1024
#: blocks from which on dropping private hashes pays for its shuffles
THIN_FROM = 24
#: hashes of a range that a task compares over all blocks
RANGE_HASHES = 1 << 22
#: matches of equal hashes, and pairs, that a task holds at a time
MATCHES, PAIRS_AT_ONCE = 1 << 21, 1 << 17
#: edges that a task holds before it drops those that no spanning tree can use
EDGES = 1 << 20
#: a sample with more matches than this part of the hashes of a block is searched in the block
DENSE = 4

# the cell function travels by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SCHEMA = "block int, sample array<string>, size array<int>, old array<boolean>, hashes binary, owners binary, ranks binary"
PAIR_SCHEMA = "a string, b string, shared int, sketch_size int"


def hash_arrays(sketch: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``sample, size, hashes``: one sorted array per sample, bounded by the sketch size.

    ``names(sample)`` lists the samples; those without a hash get an empty array.
    """
    packed = sketch.groupBy("sample").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    if names is not None:
        packed = names.select("sample").join(packed, "sample", "left").select(
            "sample", F.coalesce("hashes", F.array().cast("array<int>")).alias("hashes"))
    return packed.select("sample", F.size("hashes").alias("size"), "hashes")


def block_count(samples: int, sketch_size: int, cores: int = 1) -> int:
    """Blocks such that a cell fits a task, and there are enough cells for all cores.

    ``b`` blocks make ``b(b+1)/2`` cells; four cells a core even out their sizes.
    """
    per_block = max(BLOCK, min(MAX_BLOCK, BLOCK_HASHES // max(1, sketch_size)))
    busy = min(math.ceil(math.sqrt(8 * cores)), samples // 8)
    return max(1, -(-samples // per_block), busy)


class Block(NamedTuple):
    """The samples of a block in order of names; the hashes of all of them in ascending order, each with its owner and 1-based rank."""

    names: pa.Array
    size: np.ndarray
    old: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    rank: np.ndarray


def _pack(block: pa.Table) -> pa.Table:
    """One row of ``BLOCK_SCHEMA`` for the samples of a block."""
    block = block.take(np.argsort(np.array(block.column("sample").to_pylist(), dtype=object), kind="stable"))
    lists = block.column("hashes").combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    rank = np.arange(1, len(flat) + 1, dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
    order = np.argsort(flat, kind="stable")
    members = {c: [block.column(c).combine_chunks()] for c in ("sample", "size", "old")}
    return pa.table({
        "block": pa.array([block.column("block")[0].as_py()], pa.int32()),
        **{c: pa.ListArray.from_arrays([0, len(x[0])], x[0]) for c, x in members.items()},
        "hashes": [flat[order].tobytes()], "owners": [owner[order].tobytes()], "ranks": [rank[order].tobytes()]})


def _unpack(batch: pa.RecordBatch, i: int, side: str = "") -> Block:
    lists = (batch.column(f"{side}{c}")[i].values for c in ("sample", "size", "old"))
    names, size, old = lists
    entries = (np.frombuffer(batch.column(f"{side}{c}")[i].as_buffer(), np.int32) for c in ("hashes", "owners", "ranks"))
    return Block(names, size.to_numpy(), old.to_numpy(zero_copy_only=False), *entries)


def pack(arrays: DataFrame, blocks: int, new_only: bool = False, thin_from: int | None = None) -> DataFrame:
    """``BLOCK_SCHEMA``: the samples in ``blocks`` blocks, written once; from ``thin_from`` blocks on without hashes that only one sample has.

    With ``new_only`` old and new samples live in separate block ranges, the old ones in the first.
    """
    old = F.col("old") if new_only else F.lit(False)
    block = F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int")
    if new_only:
        block = block + F.when(F.col("old"), F.lit(0)).otherwise(F.lit(blocks))
    placed = arrays.select("sample", "size", "hashes", old.alias("old"), block.alias("block"))
    # a block is little data but a file of its own: fixed partitions keep blocks from being coalesced by size
    packed = placed.repartition(2 * blocks if new_only else blocks, "block").groupBy("block").applyInArrow(_pack, BLOCK_SCHEMA)
    packed = materialize(packed, "blocks")
    return materialize(thin(packed), "blocks") if blocks >= (thin_from or THIN_FROM) else packed


def thin(packed: DataFrame) -> DataFrame:
    """The same blocks without the hashes no other sample has; the ranks tell where the rest stood.

    Blocks send only their hashes to the tasks of the ranges these lie in, and get back a bit for each.
    """
    total = packed.agg(F.sum(F.length("hashes")).alias("n")).first()[0] or 0
    ranges = max(1, -(-total // (4 * RANGE_HASHES)))
    edges = (np.arange(1, ranges) * (1 << 32) // ranges - (1 << 31)).astype(np.int32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("hashes"), strict=True):
                flat = np.frombuffer(raw.as_buffer(), np.int32)
                parts = np.split(flat, np.searchsorted(flat, edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(ranges, dtype=np.int32)), pa.array(np.full(ranges, block, np.int32)),
                     pa.array([x.tobytes() for x in parts], pa.binary())], names=["range", "block", "hashes"])

    def mark(pieces: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.int32) for x in pieces.column("hashes")]
        seen, times = np.unique(np.concatenate(parts), return_counts=True)
        common = np.append(seen[times > 1].astype(np.int64), 1 << 40)
        bits = [np.packbits(common[np.searchsorted(common, x)] == x).tobytes() for x in parts]
        return pa.table({"block": pieces.column("block"), "range": pieces.column("range"), "bits": pa.array(bits, pa.binary())})

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: [] for c in ("hashes", "owners", "ranks")}
            for i in range(batch.num_rows):
                block, parts = _unpack(batch, i), batch.column("marks")[i].values.field("bits")
                lengths = np.diff(np.concatenate([[0], np.searchsorted(block.hashes, edges), [len(block.hashes)]]))
                keep = np.concatenate([np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=int(n)).astype(bool)
                                       for bits, n in zip(parts, lengths, strict=True)])
                for c, x in zip(columns, (block.hashes, block.owner, block.rank), strict=True):
                    columns[c].append(x[keep].tobytes())
            own = [batch.column(c) for c in ("block", "sample", "size", "old")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.binary()) for c in columns.values())], names=["block", "sample", "size", "old", *columns])

    pieces = packed.select("block", "hashes").mapInArrow(cut, "range int, block int, hashes binary")
    marks = pieces.groupBy("range").applyInArrow(mark, "block int, range int, bits binary")
    marks = marks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "bits"))).alias("marks"))
    return packed.join(marks, "block").select(*packed.columns, "marks").mapInArrow(kept, BLOCK_SCHEMA)


def _one_against_many(x: np.ndarray, x_rank: np.ndarray, limit: np.ndarray, flat: np.ndarray,
                      owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shared hashes within the bottom-s union of ``x`` and each of many sketches.

    ``flat`` lists the others' sorted hashes one sketch after the other, with
    ``owner`` and 1-based ``rank`` of each entry; ``limit`` is the union size
    with each of them.
    """
    if not len(x) or not len(flat):
        return np.zeros(len(limit), dtype=np.int64)
    at = np.searchsorted(x, flat)
    hit = np.flatnonzero(x[np.minimum(at, len(x) - 1)] == flat)
    who = owner[hit]
    # position of each hit among the hits of its sketch, 1-based
    first = np.searchsorted(who, np.arange(len(limit)))
    nth = np.arange(1, len(hit) + 1) - first[who]
    keep = x_rank[at[hit]] + rank[hit] - nth <= limit[who]
    return np.bincount(who[keep], minlength=len(limit))


def _sharing(x: Block, y: Block, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, shared`` of the pairs of a cell that share a hash within their bottom union, in order of ``i`` and ``j``.

    Equal hashes are matched, a bounded number of matches at a time.  A sample that has most hashes of the other block in
    common is searched in that block instead.
    """
    wide = len(y.size)
    # owners of equal hashes are in ascending order, so within one block the later ones are the larger ones
    start = np.arange(1, len(x.hashes) + 1) if same else np.searchsorted(y.hashes, x.hashes)
    times = np.searchsorted(y.hashes, x.hashes, side="right") - start
    per = np.bincount(x.owner, weights=times, minlength=len(x.size)).astype(np.int64)
    dense = per > len(y.hashes) // DENSE
    chunk = np.cumsum(np.where(dense, 0, per)) // MATCHES
    keys, counts = [], []
    entry_chunk = np.where(dense[x.owner] | (times == 0), -1, chunk[x.owner])
    for c in np.unique(entry_chunk):
        if c < 0:
            continue
        at = np.flatnonzero(entry_chunk == c)
        n = times[at]
        mine = np.repeat(at, n)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n - start[at], n)
        key = x.owner[mine].astype(np.int64) * wide + y.owner[other]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        nth = np.arange(1, len(key) + 1) - np.repeat(new, np.diff(np.append(new, len(key))))
        used = np.minimum(x.size[key // wide], y.size[key % wide])
        within = x.rank[mine[order]] + y.rank[other[order]] - nth <= used
        found = np.add.reduceat(within.astype(np.int64), new)
        keys.append(key[new][found > 0])
        counts.append(found[found > 0])
    if dense.any():
        by_x, by_y = (np.argsort(z.owner, kind="stable") for z in (x, y))
        x_starts = np.searchsorted(x.owner[by_x], np.arange(len(x.size) + 1))
        flat, owner, rank = y.hashes[by_y], y.owner[by_y], y.rank[by_y]
        y_starts = np.searchsorted(owner, np.arange(wide + 1))
        for i in np.flatnonzero(dense):
            lo, mine = (i + 1 if same else 0), by_x[x_starts[i]:x_starts[i + 1]]
            skip = y_starts[lo]
            found = _one_against_many(x.hashes[mine], x.rank[mine], np.minimum(y.size[lo:], x.size[i]), flat[skip:], owner[skip:] - lo, rank[skip:])
            j = np.flatnonzero(found)
            keys.append(i * wide + lo + j)
            counts.append(found[j])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, shared = np.concatenate(keys), np.concatenate(counts)
    if dense.any():
        order = np.argsort(key)
        key, shared = key[order], shared[order]
    return key // wide, key % wide, shared


def _named(pool: pa.Array, place: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    """Pairs of places in ``pool`` as rows, the smaller name first; ``place`` is the order of the names."""
    swap = place[x] > place[y]
    ends = (pool.take(pa.array(np.where(swap, *pair))) for pair in ((y, x), (x, y)))
    return pa.RecordBatch.from_arrays([*ends, pa.array(shared, pa.int32()), pa.array(used, pa.int32())], names=["a", "b", "shared", "sketch_size"])


def _places(pool: pa.Array) -> np.ndarray:
    place = np.empty(len(pool), np.int64)
    place[np.argsort(np.array(pool.to_pylist(), dtype=object), kind="stable")] = np.arange(len(pool))
    return place


def _cell_pairs(x: Block, y: Block, same: bool) -> Iterator[pa.RecordBatch]:
    """All pairs of one grid cell: row block against column block, or a block with itself; old samples are never paired again."""
    i, j, shared = _sharing(x, y, same)
    tall, wide = len(x.size), len(y.size)
    pool = pa.concat_arrays([x.names, y.names])
    place = _places(pool)
    step = max(1, PAIRS_AT_ONCE // max(1, wide))
    for top in range(0, tall, step):
        low = min(tall, top + step)
        row, col = np.repeat(np.arange(top, low), wide), np.tile(np.arange(wide), low - top)
        n = np.zeros(len(row), np.int64)
        first, last = np.searchsorted(i, [top, low])
        n[(i[first:last] - top) * wide + j[first:last]] = shared[first:last]
        wanted = ~(x.old[row] & y.old[col])
        if same:
            wanted &= col > row
        row, col, n = row[wanted], col[wanted], n[wanted]
        if len(row):
            yield _named(pool, place, row, tall + col, n, np.minimum(x.size[row], y.size[col]))


def _cells(packed: DataFrame, blocks: int, new_only: bool = False) -> DataFrame:
    """``x_..., y_...``: every pair of blocks that makes a cell, as a product that reads the written blocks and shuffles none."""
    x, y = (packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns)) for side in "xy")
    wanted = F.col("x_block") <= F.col("y_block")
    if new_only:
        wanted &= F.col("y_block") >= blocks
    return x.hint("shuffle_replicate_nl").join(y, wanted)


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Block, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            at, to = (batch.column(c)[i].as_py() for c in ("x_block", "y_block"))
            yield at, to, _unpack(batch, i, "x_"), _unpack(batch, i, "y_")


def shared_counts(arrays: DataFrame, blocks: int, new_only: bool = False) -> DataFrame:
    """``a, b, shared, sketch_size`` for every unordered pair, ``a < b``.

    With ``new_only`` the input has a flag ``old``; pairs of two old samples are
    left out, and cells that could only hold such pairs are never formed.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, to, x, y in _each_cell(batches):
            yield from _cell_pairs(x, y, at == to)

    return _cells(pack(arrays, blocks, new_only), blocks, new_only).mapInArrow(pairs, PAIR_SCHEMA)


def hash_owners(packed: DataFrame) -> DataFrame:
    """``hash, n``: how many samples of all blocks have each hash, summed up block by block in the task."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("hashes"):
                seen, times = np.unique(np.frombuffer(raw.as_buffer(), np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times, pa.int64())], names=["hash", "n"])

    return packed.select("hashes").mapInArrow(summed, "hash int, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def hash_ranks(packed: DataFrame) -> DataFrame:
    """``sample, size, rank, hash``: the blocks as a row per hash; ranks from 0."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _unpack(batch, i)
                yield pa.RecordBatch.from_arrays(
                    [block.names.take(pa.array(block.owner)), pa.array(block.size[block.owner], pa.int32()),
                     pa.array(block.rank - 1, pa.int32()), pa.array(block.hashes, pa.int32())], names=["sample", "size", "rank", "hash"])

    return packed.mapInArrow(rows, "sample string, size int, rank int, hash int")


def _lightest(nodes: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges, given in order of length, are in the spanning forest: every component takes its first outgoing edge, until none has one."""
    comp, at, chosen = np.arange(nodes), np.arange(len(u)), []
    while True:
        x, y = comp[u[at]], comp[v[at]]
        out = x != y
        at, x, y = at[out], x[out], y[out]
        if not len(at):
            return np.sort(np.concatenate(chosen)) if chosen else at
        # of several values put in one place the last stays, so from the longest edge to the shortest
        best = np.full(nodes, len(at))
        turned = np.arange(len(at))[::-1]
        best[x[::-1]] = turned
        other = np.full(nodes, len(at))
        other[y[::-1]] = turned
        best = np.minimum(best, other)
        have = np.flatnonzero(best < len(at))
        pick = best[have]
        chosen.append(at[np.unique(pick)])
        up = np.arange(nodes)
        up[have] = x[pick] + y[pick] - have
        # two that picked each other: the smaller one stays
        up = np.where((up[up] == np.arange(nodes)) & (np.arange(nodes) < up), np.arange(nodes), up)
        while not np.array_equal(up, up[up]):
            up = up[up]
        comp = up[comp]


def sharing_forest(packed: DataFrame, blocks: int) -> DataFrame:
    """``a, b, shared, sketch_size`` of pairs that share a hash within their bottom union: those that a spanning tree of all can use.

    An edge that a spanning forest of some of the edges can do without is not in the tree of all of them, whatever the
    others are.  So a task hands on the forest of its cells, at most an edge for each of their samples.  Edges are in order
    of their Jaccard index, from the largest on, and names, which is the order of either distance.
    """
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: dict[int, int] = {}
        pools: list[pa.Array] = []
        held: list[tuple[np.ndarray, ...]] = []
        nodes = 0

        def reduced() -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
            pool = pa.concat_arrays(pools)
            place = _places(pool)
            u, v, n, used = (np.concatenate(c) for c in zip(*held, strict=True))
            a, b = place[u], place[v]
            order = np.lexsort((np.maximum(a, b), np.minimum(a, b), -(n / used)))
            kept = order[_lightest(nodes, u[order], v[order])]
            return pool, place, [c[kept] for c in (u, v, n, used)]

        for at, to, x, y in _each_cell(batches):
            i, j, shared = _sharing(x, y, at == to)
            for block, z in ((at, x), (to, y)):
                if block not in base:
                    base[block] = nodes
                    pools.append(z.names)
                    nodes += len(z.size)
            if len(i):
                held.append((base[at] + i, base[to] + j, shared, np.minimum(x.size[i], y.size[j])))
            if sum(len(h[0]) for h in held) > max(EDGES, 4 * nodes):
                held = [tuple(reduced()[2])]
        if held:
            pool, place, edges = reduced()
            yield _named(pool, place, *edges)

    return _cells(packed, blocks).mapInArrow(forests, PAIR_SCHEMA)


def with_distance(pairs: DataFrame, config: DistanceConfig) -> DataFrame:
    # nothing is known to be shared with an empty sketch: distance 1, or infinite
    j = F.when(F.col("sketch_size") == 0, F.lit(0.0)).otherwise(numeric.jaccard_index(F.col("shared"), F.col("sketch_size")))
    pairs = pairs.withColumn("jaccard", j)
    d = numeric.jaccard_distance(F.col("jaccard")) if config.jaccard_distance else \
        numeric.mash_distance(F.col("jaccard"), config.kmer_size)
    return pairs.withColumn("distance", d)


def pairwise(sketch: DataFrame, config: DistanceConfig, samples: int | None = None,
             sketch_size: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """``a, b, shared, sketch_size, jaccard, distance`` for all pairs, ``a < b``; of all ``names``, if given."""
    arrays = hash_arrays(sketch, names)
    if samples is None or sketch_size is None:
        per = sketch.groupBy("sample").count().agg(F.count("*"), F.max("count")).first()
        samples, sketch_size = per[0], per[1] or 1
    cores = sketch.sparkSession.sparkContext.defaultParallelism
    return with_distance(shared_counts(arrays, block_count(samples, sketch_size, cores)), config)


def update(old_distances: DataFrame, old_sketch: DataFrame, new_sketch: DataFrame,
           config: DistanceConfig, old_names: DataFrame | None = None, new_names: DataFrame | None = None) -> DataFrame:
    """``a, b, distance`` over old and new samples; only pairs with a new one are computed.

    Old values are taken over as they are.  New values are always Mash
    distances.
    """
    config = DistanceConfig(kmer_size=config.kmer_size)
    both = hash_arrays(old_sketch, old_names).withColumn("old", F.lit(True)).unionByName(
        hash_arrays(new_sketch, new_names).withColumn("old", F.lit(False)))
    per = old_sketch.select("sample", "hash").unionByName(new_sketch.select("sample", "hash")) \
        .groupBy("sample").count().agg(F.count("*"), F.max("count")).first()
    cores = old_sketch.sparkSession.sparkContext.defaultParallelism
    fresh = with_distance(
        shared_counts(both, block_count(per[0], per[1] or 1, cores), new_only=True), config)
    return old_distances.select("a", "b", "distance").unionByName(fresh.select("a", "b", "distance"))


def bottom_union(x: Column, y: Column) -> Column:
    """The smallest hashes of the union of two sorted arrays, as many as the smaller one has."""
    return F.slice(F.sort_array(F.array_union(x, y)), F.lit(1), F.least(F.size(x), F.size(y)))


def shared_in_union(x: Column, y: Column) -> Column:
    """How many of the bottom union's hashes both arrays have; for single given pairs."""
    return F.size(F.array_intersect(bottom_union(x, y), F.array_intersect(x, y)))


def lookup(distances: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distances of given ``x, y`` pairs, in whichever order they are stored."""
    keyed = pairs.select("x", "y", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return keyed.join(distances.select("a", "b", "distance"), ["a", "b"]).select("x", "y", "distance")


def nearest(distances: DataFrame) -> DataFrame:
    """Each sample's closest other sample; ties go to the smaller name."""
    both = symmetric(distances)
    best = both.groupBy("a").agg(F.min(F.struct("distance", F.col("b").alias("nearest"))).alias("m"))
    return best.select(F.col("a").alias("sample"), "m.nearest", "m.distance")


def symmetric(distances: DataFrame) -> DataFrame:
    """Both orientations of every pair, without the diagonal."""
    half = distances.select("a", "b", "distance")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def matrix_rows(distances: DataFrame, names: DataFrame) -> DataFrame:
    """``idx, name, row``: the dense symmetric matrix, one array of values per row.

    ``names(idx, name)`` fixes row and column order.  A row is bounded by the
    number of samples; the diagonal is a literal zero.
    """
    diagonal = names.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("distance"))
    cells = symmetric(distances).unionByName(diagonal)
    cols = names.select(F.col("name").alias("b"), F.col("idx").alias("j"))
    rows = names.select(F.col("name").alias("a"), F.col("idx").alias("i"))
    packed = cells.join(cols, "b").groupBy("a").agg(
        F.sort_array(F.collect_list(F.struct("j", "distance"))).alias("cells"))
    width = names.count()
    gap = F.raise_error(F.concat(F.lit("matrix row without a value for every column: "), F.col("a")))
    return rows.join(packed, "a", "left").select(
        F.col("i").alias("idx"), F.col("a").alias("name"),
        F.when(F.size("cells") == width, F.col("cells.distance")).otherwise(gap.cast("array<double>")).alias("row"))


def matrix_wide(distances: DataFrame, names: list[str]) -> DataFrame:
    """The matrix as a table, ``$`` the row name and one column per sample (small sets only)."""
    diagonal = distances.sparkSession.createDataFrame(
        [(n, n, 0.0) for n in names], "a string, b string, distance double")
    cells = symmetric(distances).unionByName(diagonal)
    return cells.withColumnRenamed("a", "$").groupBy("$").pivot("b", names).agg(F.first("distance"))


def unpivot(wide: DataFrame) -> DataFrame:
    """Upper triangle of a wide matrix as ``a, b, distance``; column order decides what is upper."""
    names = wide.columns[1:]
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    long = wide.unpivot(wide.columns[0], names, "b", "distance").toDF("a", "b", "distance")
    return long.where(order[F.col("a")] < order[F.col("b")])

