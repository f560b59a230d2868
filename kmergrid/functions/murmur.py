"""The k-mer hash: MurmurHash3 (x86, 32 bit) as a chain of Column projections.

The hash is taken over the *base codes* (A=0, C=1, G=2, T=3, one byte per
base) of a canonical k-mer, little-endian, and returned as a signed int.  The
k-mer arrives packed two bits per base in one or more bigint columns, so every
four-base block is a shift and a mask away and the whole hash stays inside
whole-stage code generation.

Each rotate or multiply reads its input twice.  Written as one nested
expression the tree would grow exponentially, so the rounds are laid out as
successive projections; Catalyst keeps those apart because it never inlines a
non-trivial expression that is used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of MurmurHash3_x86_32 and of the seed the results must match.
SEED = 0x3C074A61
C1 = 0xCC9E2D51
C2 = 0x1B873593
BLOCK_ADD = 0xE6546B64
FINAL_MUL_1 = 0x85EBCA6B
FINAL_MUL_2 = 0xC2B2AE35

MASK32 = 0xFFFFFFFF

#: bases held by one packed bigint: 31 keeps the sign bit clear
BASES_PER_LONG = 31
#: a k-mer longer than that is packed in pieces of whole Murmur blocks
BASES_PER_PIECE = 28


def mul32(x: Column, factor: int) -> Column:
    """``x * factor mod 2**32`` for ``0 <= x < 2**32`` without leaving a bigint.

    The factor is taken as a signed 32-bit number: same residue, and the
    product then fits 63 bits, so ANSI arithmetic never overflows.
    """
    signed = factor - (1 << 32) if factor >= 1 << 31 else factor
    return (x * F.lit(signed).cast("bigint")).bitwiseAND(F.lit(MASK32))


def rotl32(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftright(x, 32 - bits)).bitwiseAND(F.lit(MASK32))


def to_signed32(x: Column) -> Column:
    """Unsigned 32-bit value in a bigint to the signed int with the same bits."""
    return F.when(x > 0x7FFFFFFF, x - F.lit(1 << 32)).otherwise(x).cast("int")


def piece_lengths(k: int) -> list[int]:
    """How many bases each packed bigint of a k-mer holds."""
    if k <= BASES_PER_LONG:
        return [k]
    full, rest = divmod(k, BASES_PER_PIECE)
    return [BASES_PER_PIECE] * full + ([rest] if rest else [])


def _blocks(k: int, packed: list[str]) -> list[tuple[Column, int]]:
    """(bits of the block, bases in it) for every four-base block in order."""
    out = []
    for name, length in zip(packed, piece_lengths(k)):
        for start in range(0, length, 4):
            size = min(4, length - start)
            shift = 2 * (length - start - size)
            bits = F.shiftright(F.col(name), shift) if shift else F.col(name)
            out.append((bits.bitwiseAND((1 << (2 * size)) - 1), size))
    return out


def _little_endian(p: Column, size: int) -> Column:
    """Spread ``size`` two-bit codes over ``size`` bytes, first code lowest."""
    word = None
    for i in range(size):
        shift_in = 2 * (size - 1 - i)
        code = F.shiftright(p, shift_in) if shift_in else p
        code = code.bitwiseAND(3)
        byte = F.shiftleft(code, 8 * i) if i else code
        word = byte if word is None else word.bitwiseOR(byte)
    return word


def with_kmer_hash(df: DataFrame, packed: str | list[str], k: int, out: str = "hash") -> DataFrame:
    """Add the signed 32-bit hash of the k-mers packed in ``packed``."""
    packed = [packed] if isinstance(packed, str) else list(packed)
    keep = df.columns
    blocks = _blocks(k, packed)
    names = [f"__m{i}" for i in range(len(blocks))]
    sizes = [size for _, size in blocks]

    def project(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return frame.withColumns(columns)

    df = project(df, {n: bits for n, (bits, _) in zip(names, blocks)})
    df = project(df, {n: _little_endian(F.col(n), s) for n, s in zip(names, sizes)})
    df = project(df, {n: mul32(F.col(n), C1) for n in names})
    df = project(df, {n: rotl32(F.col(n), 15) for n in names})
    df = project(df, {n: mul32(F.col(n), C2) for n in names})

    state: Column = F.lit(SEED).cast("bigint")
    for name, size in zip(names, sizes):
        mixed = state.bitwiseXOR(F.col(name))
        if size == 4:
            mixed = (rotl32(mixed, 13) * F.lit(5) + F.lit(BLOCK_ADD)).bitwiseAND(F.lit(MASK32))
        df = project(df, {"__h": mixed})
        state = F.col("__h")

    h = F.col("__h")
    df = project(df, {"__h": h.bitwiseXOR(F.lit(k).cast("bigint"))})
    df = project(df, {"__h": h.bitwiseXOR(F.shiftright(h, 16))})
    df = project(df, {"__h": mul32(h, FINAL_MUL_1)})
    df = project(df, {"__h": h.bitwiseXOR(F.shiftright(h, 13))})
    df = project(df, {"__h": mul32(h, FINAL_MUL_2)})
    df = project(df, {"__h": h.bitwiseXOR(F.shiftright(h, 16))})
    # Emitted through a one-element explode: a filter on the hash stays above it.
    # Pushed below, it would be rewritten in terms of every round at once.
    df = project(df, {"__h": to_signed32(h)})
    return df.select(*[c for c in keep if c != out], F.explode(F.array("__h")).alias(out))
