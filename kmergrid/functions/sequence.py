"""Column functions over nucleotide sequences.

Sequences are plain strings over ``ACGTN``.  A k-mer of up to 31 bases is also
handled *packed*: two bits per base, first base in the highest bits, so that
numeric order equals lexicographic order (A < C < G < T) and the reverse
complement is a handful of shifts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: bit groups of 2, 4, 8, 16 and 32 swapped in turn reverse the 2-bit codes
_SWAPS = (
    (2, 0x3333333333333333),
    (4, 0x0F0F0F0F0F0F0F0F),
    (8, 0x00FF00FF00FF00FF),
    (16, 0x0000FFFF0000FFFF),
    (32, 0x00000000FFFFFFFF),
)


def encode_sequence(seq: Column) -> Column:
    """Upper-case; everything outside ``ACGT`` becomes ``N``."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def is_valid(kmer: Column) -> Column:
    """True when no base of the window is unknown."""
    return ~F.contains(kmer, F.lit("N"))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of an encoded sequence; ``N`` stays ``N``."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lexicographically smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def digits(seq: Column) -> Column:
    """Bases as base-4 digits, the text form :func:`pack` reads."""
    return F.translate(seq, "ACGT", "0123")


def pack(digit_text: Column) -> Column:
    """Base-4 digits (at most 31) to a non-negative bigint, never NULL.

    Being non-nullable keeps null checks out of everything computed from it.
    """
    return F.coalesce(F.conv(digit_text, 4, 10).cast("bigint"), F.lit(0).cast("bigint"))


def reverse_complement_steps(packed: str, k: int, out: str) -> list[dict[str, Column]]:
    """Projections that put the packed reverse complement of ``packed`` in ``out``.

    Complementing a two-bit code is ``3 - code``, i.e. flipping its bits; the
    order is reversed by swapping ever larger groups of codes.
    """
    col = F.col(out)
    steps = [{out: F.bitwise_not(F.col(packed))}]
    for width, mask in _SWAPS:
        up = F.shiftleft(col.bitwiseAND(F.lit(mask)), width)
        down = F.shiftrightunsigned(col, width).bitwiseAND(F.lit(mask))
        steps.append({out: up.bitwiseOR(down)})
    steps.append({out: F.shiftrightunsigned(col, 64 - 2 * k)})
    return steps


def unpack(packed: Column, k: int) -> Column:
    """Packed k-mer back to text, four bases at a time from a list of all words of four."""
    blocks = []
    for start in range(0, k, 4):
        size = min(4, k - start)
        words = F.array(*(F.lit("".join(w)) for w in itertools.product("ACGT", repeat=size)))
        bits = F.shiftright(packed, 2 * (k - start - size)).bitwiseAND(F.lit((1 << (2 * size)) - 1))
        blocks.append(F.get(words, bits.cast("int")))
    return F.concat(*blocks)
