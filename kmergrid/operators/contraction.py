"""Values of all inner nodes of a binary tree from those of its leaves, by tree contraction.

A node between a child whose value is known and one whose value is not is a linear function of the latter.  Each round
settles the nodes whose children are settled (rake) and joins a function to that of the node it depends on (compress),
so chains halve as well as bushes and the rounds grow with the logarithm of the nodes, not with the depth.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..validate import require

#: rounds that no tree of fewer than 2**60 nodes needs
ROUNDS = 120


def midpoints(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """``node_id, val``: a leaf's value is given by ``leaves(node_id, val)``, an inner node's is the mean of its two children's.

    ``tree(node_id, left_id, right_id, is_leaf)`` may be of any depth.
    """
    settled = [materialize(leaves.select("node_id", F.col("val").cast("double").alias("val")), "settled")]
    going = materialize(tree.where(~F.col("is_leaf")).select(
        "node_id", "left_id", "right_id", F.lit(None).cast("int").alias("to"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")), "going")
    for _ in range(ROUNDS):
        if going.isEmpty():
            return functools.reduce(DataFrame.unionByName, settled)
        known = functools.reduce(DataFrame.unionByName, settled)
        look = known.select("node_id", F.col("val").alias("y"), F.lit(None).cast("int").alias("to"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")) \
            .unionByName(going.select("node_id", F.lit(None).cast("double").alias("y"), "to", "a", "b"))
        at = look.select(F.col("node_id").alias("to"), F.col("y").alias("__y"), F.col("to").alias("__to"), F.col("a").alias("__a"), F.col("b").alias("__b"))
        joined = going.where("to is not null").join(at, "to")
        moved = joined.select(
            "node_id", "left_id", "right_id", (F.col("a") * F.col("__y") + F.col("b")).alias("val"), F.coalesce("__to", "to").alias("to"),
            F.when(F.col("__to").isNull(), F.col("a")).otherwise(F.col("a") * F.col("__a")).alias("a"),
            F.when(F.col("__to").isNull(), F.col("b")).otherwise(F.col("a") * F.col("__b") + F.col("b")).alias("b"))
        left, right = (look.select(F.col("node_id").alias(f"{c}_id"), F.col("y").alias(c)) for c in ("left", "right"))
        half = F.lit(0.5)
        fresh = going.where("to is null").join(left, "left_id").join(right, "right_id").select(
            "node_id", "left_id", "right_id", (half * F.col("left") + half * F.col("right")).alias("val"),
            F.when(F.col("left").isNotNull(), F.col("right_id")).when(F.col("right").isNotNull(), F.col("left_id")).alias("to"),
            F.when(F.coalesce("left", "right").isNotNull(), half).alias("a"), (half * F.coalesce("left", "right")).alias("b"))
        step = materialize(moved.unionByName(fresh), "contracted")
        settled.append(step.where("val is not null").select("node_id", "val"))
        going = step.where("val is null").drop("val")
    require(False, "a node is its own ancestor")
