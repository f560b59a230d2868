"""Scalar formulas shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647


def estimate_genome_size(max_hash: Column, sketch_size: int) -> Column:
    """Genome size from how far up the hash range the sketch reaches.

    Uses the configured sketch size, truncates and saturates at the largest
    signed int.  NULL for an empty sketch (``least`` alone would skip the NULL).
    """
    reach = max_hash.cast("bigint") + F.lit(2147483649)
    estimate = F.lit(4294967296.0) * (F.lit(float(sketch_size)) / reach)
    return F.when(max_hash.isNotNull(), F.floor(F.least(estimate, F.lit(float(INT_MAX)))).cast("bigint"))


def jaccard_index(shared: Column, union_size: Column) -> Column:
    return shared.cast("double") / union_size


def mash_distance(jaccard: Column, k: int) -> Column:
    """``-ln(2j / (1 + j)) / k``; infinite when nothing is shared, never ``-0.0``."""
    value = F.lit(-1.0 / k) * F.ln(F.lit(2.0) * jaccard / (F.lit(1.0) + jaccard))
    return F.when(jaccard == 0, F.lit(float("inf"))).otherwise(value + F.lit(0.0))


def jaccard_distance(jaccard: Column) -> Column:
    return F.lit(1.0) - jaccard


def round2(x: Column) -> Column:
    """Two decimals, half up."""
    return F.round(x, 2)


def random_kmer_probability(genome_size: Column, k: int) -> Column:
    """Chance that a given k-mer occurs in a random genome of that size."""
    x = genome_size.cast("double")
    return x / (x + F.lit(float(4 ** k)))


def expected_jaccard(px: Column, py: Column) -> Column:
    """Expected Jaccard index of two random genomes."""
    both = px * py
    return both / (px + py - both)


def choose_two(n: Column) -> Column:
    """Number of unordered pairs."""
    return F.floor(n.cast("bigint") * (n.cast("bigint") - 1) / 2).cast("bigint")


def choose(n: int, k: int) -> int:
    return math.comb(n, k)
