"""Packed canonical k-mers and their hash for all windows of a batch of fragments, as numpy arrays.

The same values as :mod:`.sequence` and :mod:`.murmur` define.  A window is packed by doubling: windows of 2m bases from
two of m bases.  A Murmur block holds four bases, so its part of the hash comes from a table of 256 entries.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.compute import binary_length
from pyspark import cloudpickle

from . import murmur
from .murmur import BLOCK_ADD, C1, C2, FINAL_MUL_1, FINAL_MUL_2, SEED, piece_lengths

#: bytes of fragments that are hashed together: the arrays over them stay in the processor's cache
SLICE = 1 << 16

# functions over batches travel by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(murmur)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``SLICE`` bytes of a binary column."""
    lengths = binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if start < stop:
            yield batch.slice(start, stop - start)


def _runs(codes: np.ndarray, lengths: set[int], reverse: bool) -> dict[int, np.ndarray]:
    """The packed windows of each length at every position; with ``reverse``, of their reverse complements."""
    def joined(x: np.ndarray, m: int, y: np.ndarray, n: int) -> np.ndarray:
        # windows of m bases followed by those of n
        after, here = y[m:], x[:max(0, len(y) - m)]
        if reverse:
            return here | after << np.uint64(2 * m)
        return here << np.uint64(2 * n) | after

    one = (codes ^ np.uint64(3)) if reverse else codes
    powers, m = {1: one}, 1
    while 2 * m <= max(lengths):
        powers[2 * m] = joined(powers[m], m, powers[m], m)
        m *= 2
    out = {}
    for length in lengths:
        done, have = None, 0
        for bit in sorted(powers, reverse=True):
            if length & bit:
                done = powers[bit] if done is None else joined(done, have, powers[bit], bit)
                have += bit
        out[length] = done
    return out


def _table(size: int) -> np.ndarray:
    """What a Murmur block of ``size`` bases, given as packed bits, is mixed into the state as."""
    bits = np.arange(1 << (2 * size), dtype=np.uint32)
    word = np.zeros_like(bits)
    for i in range(size):
        word |= (bits >> np.uint32(2 * (size - 1 - i)) & np.uint32(3)) << np.uint32(8 * i)
    word *= np.uint32(C1)
    word = word << np.uint32(15) | word >> np.uint32(17)
    return word * np.uint32(C2)


#: the code of each byte, 4 for all that are no base
_CODES = np.array([b"ACGT".find(x) % 5 for x in range(256)], dtype=np.uint8)
_TABLES = [_table(size) for size in range(5)]


def kmer_hashes(pieces: list[np.ndarray], k: int) -> np.ndarray:
    """The signed 32-bit hash of k-mers in packed pieces."""
    h = np.full(len(pieces[0]), SEED, dtype=np.uint32)
    for piece, length in zip(pieces, piece_lengths(k)):
        for start in range(0, length, 4):
            size = min(4, length - start)
            bits = piece >> np.uint64(2 * (length - start - size)) & np.uint64((1 << (2 * size)) - 1)
            h ^= _TABLES[size][bits.astype(np.uint8)]
            if size == 4:
                h = h << np.uint32(13) | h >> np.uint32(19)
                h *= np.uint32(5)
                h += np.uint32(BLOCK_ADD)
    h ^= np.uint32(k)
    h ^= h >> np.uint32(16)
    h *= np.uint32(FINAL_MUL_1)
    h ^= h >> np.uint32(13)
    h *= np.uint32(FINAL_MUL_2)
    h ^= h >> np.uint32(16)
    return h.view(np.int32)


def canonical_windows(frags: pa.Array, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``row, pieces, forward`` of every window without a byte other than ``ACGT``: canonical k-mers in packed pieces, and whether the window is its own.

    Every fragment ends in another byte, so no window reaches into the next one.
    """
    offsets = np.frombuffer(frags.buffers()[1], dtype=np.int32)[frags.offset:frags.offset + len(frags) + 1]
    raw = _CODES[np.frombuffer(frags.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]]
    lengths = piece_lengths(k)
    if len(raw) < k:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in lengths], np.zeros(0, bool)
    strange = np.concatenate([[0], np.cumsum(raw > 3, dtype=np.int32)])
    valid = np.flatnonzero(strange[k:] == strange[:-k])
    codes = (raw & 3).astype(np.uint64)
    fwd, rev = (_runs(codes, set(lengths), reverse) for reverse in (False, True))
    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    forward = [fwd[n][valid + s] for n, s in zip(lengths, starts)]
    backward = [rev[n][valid + (k - s - n)] for n, s in zip(lengths, starts)]
    if len(lengths) == 1:
        pieces, own = [np.minimum(forward[0], backward[0])], forward[0] <= backward[0]
    else:
        smaller, same = np.zeros(len(valid), bool), np.ones(len(valid), bool)
        for f, b in zip(forward, backward):
            smaller |= same & (f < b)
            same &= f == b
        pieces, own = [np.where(smaller, f, b) for f, b in zip(forward, backward)], smaller | same
    row = np.searchsorted(offsets - offsets[0], valid, side="right") - 1
    return row, pieces, own


def window_hashes(frags: pa.Array, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``row, pieces, hash`` of the windows of :func:`canonical_windows`."""
    row, pieces, _ = canonical_windows(frags, k)
    return row, pieces, kmer_hashes(pieces, k)


def first_and_last(row: np.ndarray, pieces: list[np.ndarray], starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The smallest and the largest of the packed k-mers of each run of equal ``row`` that begins at one of ``starts``."""
    if len(pieces) == 1:
        return [np.minimum.reduceat(pieces[0], starts)], [np.maximum.reduceat(pieces[0], starts)]
    order = np.lexsort([*reversed(pieces), row])
    ends = np.append(starts[1:], len(row)) - 1
    return [p[order[starts]] for p in pieces], [p[order[ends]] for p in pieces]


def largest_window(data: np.ndarray, k: int) -> bytes:
    """The window of ``k`` bytes that comes last in their order."""
    at = np.arange(len(data) - k + 1)
    for i in range(k):
        letters = data[at + i]
        at = at[letters == letters.max()]
    return data[at[0]:at[0] + k].tobytes()


def texts(pieces: list[np.ndarray], k: int) -> pa.Array:
    """Packed pieces back to text."""
    shifts = [np.arange(2 * n - 2, -1, -2, dtype=np.uint64) for n in piece_lengths(k)]
    codes = np.concatenate([p[:, None] >> s & np.uint64(3) for p, s in zip(pieces, shifts)], axis=1)
    data = np.frombuffer(b"ACGT", dtype=np.uint8)[codes.astype(np.uint8)]
    ends = np.arange(len(data) + 1, dtype=np.int64) * k
    return pa.LargeStringArray.from_buffers(len(data), pa.py_buffer(ends), pa.py_buffer(data.tobytes())).cast(pa.string())


#: with a limit on the hashes of a group, those up to a bound that leaves about so many times the limit are counted first
AHEAD = 4


def counted(group: np.ndarray, km: np.ndarray, hash_: np.ndarray, least: int | None) -> tuple[np.ndarray, ...]:
    """``group, km, hash, cnt``: occurrences by group and hash with the smallest k-mer, of each group's ``least`` smallest hashes."""
    if least is None or not len(group):
        return _counted(group, km, hash_)
    # only low hashes can be among the smallest; a group in which they are too few is counted in full
    windows = np.bincount(group)
    share = np.minimum(1.0, AHEAD * least / np.maximum(windows, 1))
    low = hash_ <= (share * (1 << 32) - (1 << 31)).astype(np.int64)[group]
    found = _counted(group[low], km[low], hash_[low])
    short = (share < 1) & (np.bincount(found[0], minlength=len(windows)) < least)
    if short.any():
        low |= short[group]
        found = _counted(group[low], km[low], hash_[low])
    rank = np.arange(len(found[0])) - np.searchsorted(found[0], found[0])
    return tuple(x[rank < least] for x in found)


def _counted(group: np.ndarray, km: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, ...]:
    key = group.astype(np.int64) << 32 | (hash_.astype(np.int64) + (1 << 31))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    cnt = np.diff(np.append(first, len(key)))
    smallest = np.minimum.reduceat(km[order], first) if len(key) else km
    found = key[first]
    return (found >> 32).astype(np.int64), smallest, ((found & 0xFFFFFFFF) - (1 << 31)).astype(np.int32), cnt


def sorted_to_bytes(values: np.ndarray, below: int) -> bytes:
    """Ascending numbers under ``below`` in about two bits more than the logarithm of their mean gap each (Elias-Fano)."""
    n = len(values)
    low = max(0, (below // max(1, n)).bit_length() - 1)
    high = np.zeros(n + (below >> low) + 1, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    whole, rest = divmod(low, 8)
    left = values.astype("<u8").view(np.uint8).reshape(n, 8)
    bits = (left[:, whole:whole + 1] >> np.arange(rest, dtype=np.uint8) & 1).astype(np.uint8)
    return left[:, :whole].tobytes() + np.packbits(bits).tobytes() + np.packbits(high).tobytes()


def sorted_from_bytes(data: bytes, n: int, below: int) -> np.ndarray:
    """What :func:`sorted_to_bytes` was given."""
    low = max(0, (below // max(1, n)).bit_length() - 1)
    whole, rest = divmod(low, 8)
    raw, at = np.frombuffer(data, np.uint8), n * whole
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = raw[:at].reshape(n, whole)
    size = -(-n * rest // 8)
    if rest:
        bits = np.unpackbits(raw[at:at + size], count=n * rest).reshape(n, rest)
        out[:, whole] = (bits << np.arange(rest, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    high = np.flatnonzero(np.unpackbits(raw[at + size:]))[:n] - np.arange(n)
    return out.view("<i8").reshape(n) | high << low
