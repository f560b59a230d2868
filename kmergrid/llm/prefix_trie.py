"""The trie of conversation prefixes.

A conversation is the path of its turns' digests, all of one width, so the order of paths as byte strings is the
order in which a walk through the trie meets them.  Paths are dealt to shards by ranges.  A node that lies in two
shards is a prefix of the splitter between them: the trie of the splitters (the skeleton, broadcast) tells each shard
which nodes it cannot finish.  All other nodes are finished in one walk over the sorted shard; skeleton nodes leave
partial counts, which a small aggregation adds up.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmergrid.session import materialize

#: bytes of a turn's digest
WIDTH = 16
#: turns that conversations of one hundred can take over from its first
SHARED_TURNS = 5
HUNDRED = 100
#: shards at most, sampled paths per shard, turns of a sampled path, nodes of the skeleton at most (some tens of MB)
SHARDS, SAMPLE, SAMPLE_TURNS, SKELETON = 2048, 16, 64, 1 << 17
#: ids whose members are put together by one group
ID_BLOCK = 1 << 16

NODES = "conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = f"partial boolean, key binary, chars long, parent_conv_id long, {NODES}"
_NO_ENDS = hashlib.sha256().hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order as ``(turn, digest, chars)``, the null turn first.

    ``turns(conv_id, turn, role, text)``; null role or text is empty.  Turns that tie go by their digest.  The texts stay
    behind: what is kept of a turn has 33 bytes.  Rows without a conversation id are one conversation, with a null id.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Let conversations start with the turns of the first one of their hundred.

    Conversation c gets the first h turns of conversation c - c % 100 (all if it has fewer, none if there is none), then
    its own turns after its first h, where h is crc32(decimal c) % 6.  A null id has h = 0.
    """
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.lit(0)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    firsts = convs.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS).alias("first"))
    own = convs.select("conv_id", base.alias("base"), h.alias("h"), "turns").join(firsts, "base", "left")
    head = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return own.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``path, chars, block, n, least, ids``: conversations that are the same path and whose ids lie in one block together.

    ``ids`` are their decimal ids in ascending order.  However many conversations are equal, a group has one block.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"),
                         F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    return keyed.groupBy("path", "block").agg(
        F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(ids, ",").alias("ids"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    i, stop = 0, min(len(a), len(b))
    while i < stop and a[i:i + WIDTH] == b[i:i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def choose_splitters(sample: list[bytes], shards: int, most: int = SKELETON) -> list[bytes]:
    """At most ``shards - 1`` ascending splitters out of a sample, cut where they begin to differ from the path before.

    Every second one goes until their trie has at most ``most`` nodes, so that it can be broadcast at any size.
    """
    sample = sorted(set(sample))
    found = []
    for k in range(1, shards):
        at = k * len(sample) // shards
        if at > 0:
            found.append(sample[at][:(_common(sample[at - 1], sample[at]) + 1) * WIDTH])
    found = sorted(set(found))
    while sum(len(b) // WIDTH - _common(a, b) for a, b in pairwise([b"", *found])) > most:
        found = found[1::2]
    return found


def _splitters(distinct: DataFrame, shards: int) -> list[bytes]:
    """From the ``SAMPLE * shards`` distinct paths with the smallest hashes; their beginnings are all that is collected."""
    start = F.substring("path", 1, SAMPLE_TURNS * WIDTH).alias("start")
    drawn = distinct.select("path").distinct().orderBy(F.xxhash64("path"), "path").limit(SAMPLE * shards).select(start)
    return choose_splitters([bytes(r["start"]) for r in drawn.collect()], shards)


def skeleton(splitters: list[bytes]) -> set[bytes]:
    """All nodes that may lie in several shards: every prefix of a splitter, the root among them."""
    return {b""} | {s[:i] for s in splitters for i in range(WIDTH, len(s) + 1, WIDTH)}


def _deal(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = [bisect.bisect_right(splitters, p) for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])


class _Node:
    __slots__ = ("chars", "convs", "depth", "ends", "finished", "kids", "key", "least", "leaves", "saved")

    def __init__(self, depth: int, key: bytes | None, chars: int):
        self.depth, self.key, self.chars = depth, key, chars
        self.convs = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None
        #: rows of finished children, which wait for this node's smallest member
        self.finished: list[tuple] = []

    def join(self, convs: int, least: int | None) -> None:
        self.convs += convs
        if least is not None and (self.least is None or least < self.least):
            self.least = least


def _walk(rows: Iterator[tuple], split: set[bytes]) -> Iterator[tuple]:
    """Nodes of a shard from its paths in ascending order; rows are (path, chars, n, least, ids).

    Held are the open nodes (one path) and their finished children.  A skeleton node keeps no children: it is not
    finished here, and they leave with its key.
    """
    stack: list[_Node] = []
    last = b""

    def close() -> Iterator[tuple]:
        node = stack.pop()
        above = stack[-1] if stack else None
        if above is not None:
            above.join(node.convs, node.least)
        ends = node.ends.hexdigest() if node.ends else None
        if node.key is not None:
            yield (True, node.key, node.chars, None, node.least, node.depth, node.convs, node.kids, node.leaves, node.saved, ends)
            return
        for child in node.finished:
            yield (False, None, None, node.least, *child)
        leaves = node.leaves if node.kids else 1
        saved = node.saved + (node.convs - 1) * node.chars
        own = (node.least, node.depth, node.convs, node.kids, leaves, saved, ends or _NO_ENDS)
        above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + leaves, above.saved + saved
        if above.key is not None:
            yield (False, above.key, None, None, *own)
        else:
            above.finished.append(own)

    for path, chars, n, least, ids in rows:
        if not stack:
            stack.append(_Node(0, b"", 0))
        common = _common(last, path)
        while len(stack) > common + 1:
            yield from close()
        for depth in range(len(stack), len(path) // WIDTH + 1):
            # only below a skeleton node can there be another
            key = path[:depth * WIDTH] if stack[-1].key is not None else None
            stack.append(_Node(depth, key if key in split else None, chars[depth - 1]))
        top = stack[-1]
        top.join(n, least)
        if top.ends is None:
            top.ends = hashlib.sha256()
        else:
            top.ends.update(b",")
        top.ends.update(ids.encode())
        last = path
    while stack:
        yield from close()


_TYPES = (pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _finish(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "n", "least", "ids")), strict=True)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

    held: list[tuple] = []
    for node in _walk(rows(), skeleton(splitters)):
        held.append(node)
        if len(held) >= 4096:
            yield packed(held)
            held = []
    if held:
        yield packed(held)


def _combine(partial: DataFrame) -> DataFrame:
    """Skeleton nodes from their shards' parts: ``key, parent_key`` and the columns of a node."""
    sums = partial.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    up = F.when(F.col("depth") > 0, F.expr(f"substring(key, 1, (depth - 1) * {WIDTH})"))
    nodes = materialize(sums.withColumn("parent_key", up), "skeleton")
    kids = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    full = nodes.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    full = materialize(full.drop("more").withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                       .withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "skeleton")
    # what is below a skeleton node but not below another one has been added up: every node adds its part to all above it
    prefix = F.expr(f"explode(transform(sequence(0, depth), d -> substring(key, 1, d * {WIDTH})))")
    below = full.select(prefix.alias("key"), (F.col("n_leaves") + F.col("leaf")).alias("l"), (F.col("saved_tokens") + F.col("own")).alias("s")) \
        .groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    return materialize(full.drop("n_leaves", "saved_tokens").join(below, "key").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")), "skeleton")


def trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie over ``convs(conv_id, turns)``, turns as :func:`conversations` gives them.

    Each distinct beginning of d turns is a node of depth d, from the root (d = 0).  Columns: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members: conversations that begin so),
    ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (summed over the subtree, members
    less one times the characters of the node's last text), ``ends_sha256`` (SHA-256 of the decimal ids, in ascending
    order with commas between, of the members that end here).

    Conversations without turns are members of the root alone; no conversation gives no node.  A null id counts as a
    member, comes after all others and adds nothing to the digests; it is a node's ``conv_id`` where it is the only one.
    Equal conversations are put together before they are shuffled to their shard; only the digest of the ids has to
    be worked out one after the other, over one string per 65,536 ids.
    """
    spark = convs.sparkSession
    if shards is None:
        shards = min(SHARDS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    distinct = materialize(paths(convs), "paths")
    splitters = _splitters(distinct, shards)
    kind = "shard int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    dealt = distinct.mapInArrow(functools.partial(_deal, splitters=splitters), kind).repartitionById(len(splitters) + 1, F.col("shard"))
    # null ids are a block of their own, after the others
    ordered = dealt.sortWithinPartitions("shard", "path", F.col("block").asc_nulls_last())
    nodes = materialize(ordered.mapInArrow(functools.partial(_finish, splitters=splitters), _OUT), "nodes")
    split = _combine(nodes.where("partial"))
    names = split.select("key", F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("not partial and key is null").select(*columns)
    # at most SKELETON rows
    outer = nodes.where("not partial and key is not null").drop("parent_conv_id").join(F.broadcast(names), "key") \
        .withColumnRenamed("above", "parent_conv_id").select(*columns)
    top = split.join(F.broadcast(names.withColumnRenamed("key", "parent_key")), "parent_key", "left") \
        .withColumnRenamed("above", "parent_conv_id").select(*columns)
    return inner.unionByName(outer).unionByName(top).withColumn("depth", F.col("depth").cast("long"))


def prefix_nodes(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """:func:`trie` of the conversations of ``turns(conv_id, turn, role, text)`` as they are."""
    return trie(conversations(turns), shards)
