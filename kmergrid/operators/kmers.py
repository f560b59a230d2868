"""From sequences to hashed canonical k-mers, one row per window.

The input is ``sequences(sample, seq, ...)``; nothing here shuffles.  A record
is first split at unknown bases (no window may contain one) and into
overlapping chunks, so that one chromosome-sized record never becomes a
chromosome-sized array.  Slicing works on BINARY: substring on STRING walks the
text from its start for every window.  Windows are packed and hashed by numpy,
many fragments at a time (:mod:`..functions.hashing`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import murmur
from ..functions import sequence as S
from ..functions.hashing import (
    canonical_windows, counted, first_and_last, largest_window, slices, sorted_from_bytes, sorted_to_bytes, texts, window_hashes)
from ..session import materialize

#: windows per chunk; a chunk carries ``k - 1`` extra bases of overlap
CHUNK_WINDOWS = 8192
#: windows whose hashes a task packs together, and about as many of a hash range are counted at a time
HELD = 1 << 22
#: bytes of the Arrow batches of tasks that hold so many
TASK_BATCH = 4 << 20
#: occurrences of a hash among them from which on it is packed with its count
OFTEN = 8
#: ranges of hashes that are counted apart, and how many times the planner's guess of the size their number goes by
LEAST_RANGES, MOST_RANGES, GUESS = 256, 1 << 14, 4
#: bits of the filter of well-covered hashes, at most, and in each of its pieces
FILTER_BITS, PIECE_BITS = 1 << 28, 1 << 20


def fragments(sequences: DataFrame, k: int, keep: Sequence[str] = ("sample",),
              chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """``keep..., frag``: maximal runs of known bases, cut into overlapping chunks.

    Every valid window of length ``k`` lies in exactly one fragment.
    """
    keep = list(keep)
    runs = sequences.select(*keep, F.explode(F.split(S.encode_sequence(F.col("seq")), "N+")).alias("__run"))
    runs = runs.where(F.length("__run") >= k).withColumn("__run", S.digits(F.col("__run")).cast("binary"))
    cut = runs.withColumn(
        "__at", F.explode(F.sequence(F.lit(1), F.length("__run") - F.lit(k - 1), F.lit(chunk))))
    return cut.select(*keep, F.substring("__run", F.col("__at"), F.lit(chunk + k - 1)).alias("frag"))


def windows(sequences: DataFrame, k: int, keep: Sequence[str] = ("sample",), chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """``keep..., pos, kmer``: every window as text with its 0-based position, unknown bases included.

    The plain view of a sequence; :func:`kmers` is the fast path.  Records are cut into overlapping chunks here, too.
    """
    keep = list(keep)
    cut = _encoded_chunks(sequences, k, keep, chunk)
    at = cut.withColumn("__i", F.explode(F.sequence(F.lit(1), F.length("__c") - F.lit(k - 1))))
    return at.select(*keep, (F.col("__at") + F.col("__i") - 2).alias("pos"),
                     F.substring("__c", F.col("__i"), F.lit(k)).cast("string").alias("kmer"))


def _encoded_chunks(sequences: DataFrame, k: int, keep: Sequence[str], chunk: int) -> DataFrame:
    """``keep..., __at, __c``: overlapping chunks of encoded sequences as bytes, with their 1-based position."""
    encoded = sequences.select(*keep, S.encode_sequence(F.col("seq")).cast("binary").alias("__b")).where(F.length("__b") >= k)
    cut = encoded.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length("__b") - F.lit(k - 1), F.lit(chunk))))
    return cut.select(*keep, "__at", F.substring("__b", F.col("__at"), F.lit(chunk + k - 1)).alias("__c"))


def window_summary(sequences: DataFrame, k: int, by: str, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """``by, n_windows, n_valid, pos_sum, last_kmer`` over the rows of :func:`windows`, which are summed up chunk by chunk in the task.

    Counted are all windows and those without an unknown base, of which the positions are added up; ``last_kmer`` is
    the last of all as text.
    """
    cut = _encoded_chunks(sequences, k, [by], chunk)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, valids, sums, last = [], [], [], []
            for at, part in zip(batch.column("__at").to_pylist(), batch.column("__c").to_pylist(), strict=True):
                data = np.frombuffer(part, np.uint8)
                unknown = np.concatenate([[0], np.cumsum(data == ord("N"))])
                valid = np.flatnonzero(unknown[k:] == unknown[:-k])
                counts.append(len(data) - k + 1)
                valids.append(len(valid))
                sums.append(int(valid.sum()) + (at - 1) * len(valid) if len(valid) else None)
                last.append(largest_window(data, k).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(by), pa.array(counts, pa.int64()), pa.array(valids, pa.int64()), pa.array(sums, pa.int64()), pa.array(last, pa.string())],
                names=[by, "n", "v", "p", "kmer"])

    kind = cut.schema[by].dataType.simpleString()
    parts = cut.mapInArrow(summed, f"`{by}` {kind}, n bigint, v bigint, p bigint, kmer string")
    return parts.groupBy(by).agg(F.sum("n").alias("n_windows"), F.sum("v").alias("n_valid"), F.sum("p").alias("pos_sum"), F.max("kmer").alias("last_kmer"))


def canonical_summary(sequences: DataFrame, k: int, by: str, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """``by, n_forward, first_kmer, last_kmer`` over the canonical k-mers of all valid windows, summed up chunk by chunk in the task.

    ``n_forward`` counts the windows that are their own canonical k-mer.
    """
    cut = _encoded_chunks(sequences, k, [by], chunk).select(by, F.concat("__c", F.lit(b"N")).alias("frag"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "frag"):
                row, pieces, own = canonical_windows(part.column("frag"), k)
                if len(row):
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    first, last = first_and_last(row, pieces, starts)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(by).take(pa.array(row[starts])), pa.array(np.add.reduceat(own.astype(np.int64), starts)), texts(first, k), texts(last, k)],
                        names=[by, "n", "first", "last"])

    kind = cut.schema[by].dataType.simpleString()
    parts = cut.mapInArrow(summed, f"`{by}` {kind}, n bigint, first string, last string")
    return parts.groupBy(by).agg(F.sum("n").alias("n_forward"), F.min("first").alias("first_kmer"), F.max("last").alias("last_kmer"))


def _chunks(sequences: DataFrame, k: int, keep: Sequence[str], chunk: int) -> DataFrame:
    """``keep..., frag``: overlapping chunks as bytes; one that is no base ends each, so that those of a batch can be read as one text."""
    bytes_ = sequences.select(*keep, F.upper("seq").cast("binary").alias("__b"))
    cut = bytes_.withColumn("__at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("__b") - F.lit(k - 1), F.lit(1)), F.lit(chunk))))
    return cut.select(*keep, F.concat(F.substring("__b", F.col("__at"), F.lit(chunk + k - 1)), F.lit(b"N")).alias("frag"))


def kmers(sequences: DataFrame, k: int, keep: Sequence[str] = ("sample",),
          chunk: int = CHUNK_WINDOWS, bound: str | None = None, hash_only: bool = False) -> DataFrame:
    """``keep..., packed columns, hash`` for every valid window.

    For ``k <= 31`` the canonical k-mer is one bigint ``km``; longer k-mers carry the text ``kmer`` instead;
    ``hash_only`` leaves both out.  With ``bound``, a column of the input, only hashes up to it leave the task.
    """
    keep = list(keep)
    carried = keep if bound is None or bound in keep else [*keep, bound]
    frags = _chunks(sequences, k, carried, chunk)
    types = {f.name: f.dataType.simpleString() for f in frags.schema.fields}
    rep = [] if hash_only else ["km bigint"] if k <= murmur.BASES_PER_LONG else ["kmer string"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *rep, "hash int"])
    names = [*keep, *(x.split()[0] for x in rep), "hash"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "frag"):
                at, packed, hash_ = window_hashes(part.column("frag"), k)
                if bound is not None:
                    low = np.flatnonzero(hash_ <= part.column(bound).to_numpy(zero_copy_only=False)[at])
                    at, packed, hash_ = at[low], [p[low] for p in packed], hash_[low]
                columns = [part.column(c).take(pa.array(at)) for c in keep]
                if not hash_only:
                    columns.append(pa.array(packed[0].view(np.int64)) if len(packed) == 1 else texts(packed, k))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hash_)], names=names)

    return frags.mapInArrow(hashed, schema)


def hash_summary(sequences: DataFrame, k: int, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """``sample, n, hash_sum, hash_min, hash_max`` over the hashes of all valid windows, summed up in the task that reads them."""
    frags = _chunks(sequences, k, ["sample"], chunk)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "frag"):
                row, _, hash_ = window_hashes(part.column("frag"), k)
                if len(row):
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    found = pa.table({"sample": part.column("sample").take(pa.array(row[starts])), "n": np.diff(np.append(starts, len(row))),
                                      "s": np.add.reduceat(hash_, starts, dtype=np.int64), "low": np.minimum.reduceat(hash_, starts),
                                      "high": np.maximum.reduceat(hash_, starts)})
                    per = found.group_by("sample").aggregate([("n", "sum"), ("s", "sum"), ("low", "min"), ("high", "max")])
                    yield from per.select(["sample", "n_sum", "s_sum", "low_min", "high_max"]).rename_columns(["sample", "n", "s", "low", "high"]).to_batches()

    parts = frags.mapInArrow(summed, "sample string, n bigint, s bigint, low int, high int")
    return parts.groupBy("sample").agg(F.sum("n").alias("n"), F.sum("s").alias("hash_sum"), F.min("low").alias("hash_min"), F.max("high").alias("hash_max"))


def least_hashes(sequences: DataFrame, k: int, least: int) -> DataFrame:
    """``sample, hashes``: the ``least`` smallest distinct hashes of each sample in ascending order; no row for a sample without any.

    A task hands on one list for each sample and piece it reads, so only as many rows as there are pieces are shuffled.
    One task gathers the lists of a sample: for samples of few records.
    """
    frags = _chunks(sequences, k, ["sample"], CHUNK_WINDOWS)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "frag"):
                at, packed, hash_ = window_hashes(part.column("frag"), k)
                names = part.column("sample").dictionary_encode()
                group = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
                group, _, hash_, _ = counted(group[at], packed[0], hash_, least)
                owner, starts = np.unique(group, return_index=True)
                sample = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)]).take(pa.array(owner))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(hash_)).astype(np.int32)), pa.array(hash_))
                yield pa.RecordBatch.from_arrays([sample, lists], names=["sample", "hashes"])

    parts = frags.mapInArrow(listed, "sample string, hashes array<int>").groupBy("sample").agg(F.collect_list("hashes").alias("hashes"))
    return parts.select("sample", F.slice(F.sort_array(F.array_distinct(F.flatten("hashes"))), 1, least).alias("hashes"))


def kmer_counts(sequences: DataFrame, k: int, bound: str | None = None, least: int | None = None, covered: int | None = None) -> DataFrame:
    """``sample, km, hash, cnt``: occurrences of each hash with the smallest k-mer, added up as far as a task reads them together.

    ``bound`` as in :func:`kmers`.  ``least`` keeps the smallest hashes of a sample in each such piece: a hash among the
    ``least`` smallest of the whole sample is among those of every piece it occurs in, so its sum stays exact.  With
    ``covered`` only the sums of hashes that occur so many times in a sample are, see :func:`covered_kmers`.
    """
    if k > murmur.BASES_PER_LONG:
        return kmers(sequences, k, bound=bound).withColumn("cnt", F.lit(1).cast("bigint"))
    if covered is not None:
        return covered_kmers(sequences, k, covered)
    carried = ["sample"] if bound is None else ["sample", bound]
    frags = _chunks(sequences, k, carried, CHUNK_WINDOWS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "frag"):
                at, packed, hash_ = window_hashes(part.column("frag"), k)
                km = packed[0]
                if bound is not None:
                    low = np.flatnonzero(hash_ <= part.column(bound).to_numpy(zero_copy_only=False)[at])
                    at, km, hash_ = at[low], km[low], hash_[low]
                names = part.column("sample").dictionary_encode()
                group = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
                group, km, hash_, cnt = counted(group[at], km, hash_, least)
                sample = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)]).take(pa.array(group))
                yield pa.RecordBatch.from_arrays(
                    [sample, pa.array(km.view(np.int64)), pa.array(hash_), pa.array(cnt.astype(np.int64))], names=["sample", "km", "hash", "cnt"])

    return frags.mapInArrow(summed, "sample string, km bigint, hash int, cnt bigint")


def _named(column: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The distinct values of a column of texts, and the place of each row's among them."""
    names = column.dictionary_encode()
    return [*names.dictionary.to_pylist(), *([None] if names.null_count else [])], names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)


def _numbers(names: list[str | None], ids: dict[str | None, int]) -> np.ndarray:
    """The numbers of the names in ``ids``, in which new ones are entered."""
    return np.array([ids.setdefault(x, len(ids)) for x in names], np.int64)


def covered_hashes(sequences: DataFrame, k: int, covered: int) -> DataFrame:
    """``sample, hash, cnt``: the hashes that occur at least ``covered`` times in a sample.

    All hashes are dealt out by ranges, but only the hashes: a task sorts those of many windows and packs them, which
    takes about two bytes for each instead of a row.  One that a task meets more than ``OFTEN`` times goes with its count.
    """
    # the planner's guess of the size is often too low, hence the factor; too many ranges only make smaller pieces
    guess = int(str(sequences._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, GUESS * guess // HELD))
    width = -(-(1 << 32) // ranges)
    frags = _chunks(sequences, k, ["sample"], CHUNK_WINDOWS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str | None, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def pieces() -> Iterator[pa.RecordBatch]:
            # sorted by range, sample and hash
            key = np.concatenate(held)
            held.clear()
            low = key & 0xFFFFFFFF
            at = low // width
            key >>= 32
            key += at * len(ids)
            key *= width
            at *= width
            low -= at
            key += low
            del low, at
            key.sort()
            names, span = pa.array(list(ids), pa.string()), len(ids) * width
            starts = np.searchsorted(key, np.arange(ranges + 1) * span)
            for i in np.flatnonzero(np.diff(starts)):
                part = key[starts[i]:starts[i + 1]] - i * span
                own, place = np.unique(part // width, return_inverse=True)
                part = place * width + part % width
                runs = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                times = np.diff(np.append(runs, len(part)))
                many = times > OFTEN
                hot = part[runs[many]].tobytes(), times[many].astype(np.int64).tobytes()
                part = part[np.repeat(~many, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([len(part)], pa.int32()), pa.ListArray.from_arrays([0, len(own)], names.take(pa.array(own))),
                     *(pa.array([x], pa.binary()) for x in (sorted_to_bytes(part, len(own) * width), *hot))], names=["range", "n", "samples", "hashes", "hot", "times"])

        for batch in batches:
            for part in slices(batch, "frag"):
                at, _, hash_ = window_hashes(part.column("frag"), k)
                names, row = _named(part.column("sample"))
                held.append(_numbers(names, ids)[row[at]] << 32 | (hash_.astype(np.int64) + (1 << 31)))
                size += len(at)
                if size >= HELD:
                    yield from pieces()
                    ids, size = {}, 0
        if size:
            yield from pieces()

    def added(rows: pa.Table) -> pa.Table:
        first = rows.column("range")[0].as_py() * width - (1 << 31)
        ids: dict[str | None, int] = {}
        keys, counts = [], []
        for i, (n, samples) in enumerate(zip(rows.column("n").to_pylist(), rows.column("samples").to_pylist(), strict=True)):
            data, hot, times = (rows.column(c)[i].as_buffer() for c in ("hashes", "hot", "times"))
            own = _numbers(samples, ids)
            value = np.concatenate([sorted_from_bytes(data, n, len(samples) * width), np.frombuffer(hot, np.int64)])
            keys.append(own[value // width] * width + value % width)
            counts.append(np.concatenate([np.ones(n, np.int64), np.frombuffer(times, np.int64)]))
        key, cnt = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, cnt = key[order], cnt[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cnt = np.add.reduceat(cnt, at)
        often = cnt >= covered
        key = key[at[often]]
        return pa.table({"sample": pa.array(list(ids), pa.string()).take(pa.array(key // width)), "hash": pa.array(key % width + first, pa.int32()),
                         "cnt": pa.array(cnt[often], pa.int64())})

    dealt = frags.mapInArrow(packed, "range int, n int, samples array<string>, hashes binary, hot binary, times binary")
    return dealt.groupBy("range").applyInArrow(added, "sample string, hash int, cnt bigint")


def _filter_places(offset: np.ndarray, hash_: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a hash of a sample in a filter of ``bits`` bits, a power of two."""
    mixed = (hash_.view(np.uint32) + offset) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - bits.bit_length() + 1)).astype(np.int64)


def _offsets(names: list[str | None]) -> np.ndarray:
    return np.array([zlib.crc32((x or "").encode()) for x in names], np.uint32)


def _filter(covered: DataFrame, bits: int) -> np.ndarray:
    """The filter of the hashes of all samples, packed; its pieces are put together by tasks."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, row = _named(batch.column("sample"))
            place = np.unique(_filter_places(_offsets(names)[row], batch.column("hash").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(place // PIECE_BITS, pa.int32()), pa.array(place % PIECE_BITS, pa.int32())], names=["piece", "place"])

    def piece(rows: pa.Table) -> pa.Table:
        there = np.zeros(min(bits, PIECE_BITS), np.uint8)
        there[rows.column("place").to_numpy()] = 1
        return pa.table({"piece": rows.column("piece").slice(0, 1), "bits": pa.array([np.packbits(there).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    found = covered.select("sample", "hash").mapInArrow(places, "piece int, place int").groupBy("piece").applyInArrow(piece, "piece int, bits binary")
    for row in found.toLocalIterator():
        out[row.piece * PIECE_BITS // 8:][:len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def covered_kmers(sequences: DataFrame, k: int, covered: int) -> DataFrame:
    """``sample, km, hash, cnt`` as :func:`kmer_counts`, for hashes that occur at least ``covered`` times in a sample.

    Each has one row; others are left out.  Hashes are counted first, by themselves (:func:`covered_hashes`), and the
    texts are read again for the k-mers of the well-covered ones, which a filter of bounded size tells from most others.
    """
    often = materialize(covered_hashes(sequences, k, covered), "covered", TASK_BATCH)
    bits = min(FILTER_BITS, max(8, 1 << (16 * often.count()).bit_length()))
    there = sequences.sparkSession.sparkContext.broadcast(_filter(often, bits))
    frags = _chunks(sequences, k, ["sample"], CHUNK_WINDOWS)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = there.value
        ids: dict[str | None, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            group, km, hash_, _ = counted(*(np.concatenate(c) for c in zip(*held, strict=True)), None)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(ids), pa.string()).take(pa.array(group)), pa.array(km.view(np.int64)), pa.array(hash_), pa.array(np.zeros(len(km), np.int64))],
                names=["sample", "km", "hash", "cnt"])

        for batch in batches:
            for part in slices(batch, "frag"):
                at, pieces, hash_ = window_hashes(part.column("frag"), k)
                names, row = _named(part.column("sample"))
                place = _filter_places(_offsets(names)[row[at]], hash_, bits)
                hit = np.flatnonzero(packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                held.append((_numbers(names, ids)[row[at[hit]]], pieces[0][hit], hash_[hit]))
                size += len(hit)
                if size >= HELD // 16:
                    yield rows()
                    ids, held, size = {}, [], 0
        if size:
            yield rows()

    found = frags.mapInArrow(kept, "sample string, km bigint, hash int, cnt bigint")
    both = found.unionByName(often.select("sample", F.lit(None).cast("bigint").alias("km"), "hash", "cnt"))
    # tasks have added up what they hold; adding up once more before the shuffle would hardly save a row
    exact = both.repartition("sample", "hash").groupBy("sample", "hash").agg(F.sum("cnt").alias("cnt"), F.min("km").alias("km")).where("cnt > 0")
    return materialize(exact.select("sample", "km", "hash", "cnt"), "covered", TASK_BATCH)
