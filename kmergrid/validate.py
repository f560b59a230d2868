"""Checks the workflows run before (or after) the heavy part.

Each raises ``ValueError`` listing the first few offenders; only those few rows
ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 10


def _sample(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(column).orderBy(column).limit(SHOWN).collect()]


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def unique_samples(meta: DataFrame) -> None:
    """Every sketch name appears once."""
    twice = meta.groupBy("sample").count().where("count > 1")
    bad = _sample(twice, "sample")
    require(not bad, f"sketch names that appear more than once: {bad}")


def sketch_set(meta: DataFrame) -> tuple[int, int, int]:
    """``(k, smallest sketch, sketches)`` of a set of sketches with one k and unique names.

    Differing sketch sizes are allowed; callers use the smallest.  Sketches without a hash, of samples shorter than k,
    do not count for it: cutting others to their size would empty them.
    """
    row = meta.agg(
        F.min("kmer_length").alias("k0"), F.max("kmer_length").alias("k1"),
        F.coalesce(F.min(F.when(F.col("sketch_size") > 0, F.col("sketch_size"))), F.lit(0)).alias("s"),
        F.count("*").alias("n")).first()
    require(row["n"] > 0, "no sketches given")
    require(row["k0"] == row["k1"], f"sketches with different k-mer lengths: {row['k0']} .. {row['k1']}")
    unique_samples(meta)
    return row["k0"], row["s"], row["n"]


def update_inputs(old_meta: DataFrame, new_meta: DataFrame) -> tuple[int, int, int]:
    """Old and new sketches agree on k and smallest size and share no name."""
    k_old, s_old, n_old = sketch_set(old_meta)
    k_new, s_new, n_new = sketch_set(new_meta)
    require(k_old == k_new, f"k-mer length of the new sketches ({k_new}) differs from the old ({k_old})")
    require(s_old == s_new, f"sketch size of the new sketches ({s_new}) differs from the old ({s_old})")
    bad = _sample(new_meta.join(old_meta, "sample", "left_semi"), "sample")
    require(not bad, f"sketches present in both sets: {bad}")
    return k_old, n_old, n_new


def same_names(names: list[str], meta: DataFrame) -> None:
    """A matrix is about exactly the samples of its sketches."""
    listed = meta.sparkSession.createDataFrame([(n,) for n in names], "sample string")
    absent = _sample(listed.join(meta, "sample", "left_anti"), "sample")
    require(not absent, f"matrix columns without a sketch: {absent}")
    extra = _sample(meta.join(listed, "sample", "left_anti"), "sample")
    require(not extra, f"sketches that the matrix does not list: {extra}")


def query_inputs(meta: DataFrame, smallest: int, kmer_length: int) -> None:
    """Query sketches can be compared with a tree: it has sketches, and the same k."""
    require(smallest > 0, "the tree was built without sketches, or only with empty ones")
    bad = _sample(meta.where(F.col("kmer_length") != kmer_length), "sample")
    require(not bad, f"query sketches whose k-mer length is not the tree's {kmer_length}: {bad}")


def labels_cover(tree: DataFrame, labels: DataFrame) -> None:
    """Exactly one label per leaf."""
    leaves = tree.where("is_leaf").select(F.col("name").alias("leaf"))
    missing = _sample(leaves.join(labels, "leaf", "left_anti"), "leaf")
    require(not missing, f"leaves without a label: {missing}")
    extra = _sample(labels.join(leaves, "leaf", "left_anti"), "leaf")
    require(not extra, f"labels for unknown leaves: {extra}")


def colours_cover(tree: DataFrame, colours: DataFrame) -> None:
    leaves = tree.where("is_leaf").select(F.col("name").alias("label"))
    missing = _sample(leaves.join(colours, "label", "left_anti"), "label")
    require(not missing, f"leaves without a colour: {missing}")


def matrix_covers(tree: DataFrame, names: list[str]) -> None:
    leaves = tree.where("is_leaf").select("name")
    require(leaves.count() == len(names), "matrix columns and leaves differ in number")
    cols = tree.sparkSession.createDataFrame([(n,) for n in names], "name string")
    missing = _sample(cols.join(leaves, "name", "left_anti"), "name")
    require(not missing, f"matrix columns that are not leaves: {missing}")


def proportions_sum_to_one(props: DataFrame) -> None:
    """Each drawn query's proportions round to 1 at two decimals; blanked queries are exempt."""
    total = props.groupBy("name").agg(F.sum("weight").alias("total"), F.max("weight").alias("top"))
    bad = _sample(total.where((F.col("top") > 0) & (F.round("total", 2) != 1.0)), "name")
    require(not bad, f"queries whose proportions do not sum to 1: {bad}")
