"""Binary trees as tables, and the subtree operators on them.

A tree is ``tree(node_id, parent_id, left_id, right_id, is_leaf, name, dist,
depth, lo, hi)``.  Ids are in-order positions, so leaves are even, internal
nodes odd, and the subtree of a node is exactly the id interval ``[lo, hi]``.
Most tree questions then need no recursion and no range join: they are
arithmetic on the interval, or a running sum over positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize
from .contraction import midpoints
from .intervals import SIZES, interval_join

TREE_SCHEMA = ("node_id int, parent_id int, left_id int, right_id int, is_leaf boolean, name string, "
               "dist double, depth int, lo int, hi int")


def leaves(tree: DataFrame) -> DataFrame:
    """``node_id, name`` of the leaves."""
    return tree.where("is_leaf").select("node_id", "name")


def leaf_order(tree: DataFrame) -> DataFrame:
    """``position, name``: leaves from left to right."""
    return leaves(tree).select((F.col("node_id") / 2).cast("int").alias("position"), "name")


def post_order(tree: DataFrame) -> DataFrame:
    """``position, node_id`` of the internal nodes: children before parents, left before right.

    All ``hi / 2`` internal ids below ``hi`` precede a node or are the node
    itself, except its ancestors with a smaller id: those wait for their right side.
    """
    inner = tree.where(~F.col("is_leaf"))
    steps = F.array(F.struct((F.col("node_id") + 1).alias("pos"), F.lit(1.0).alias("val")),
                    F.struct((F.col("hi") + 1).alias("pos"), F.lit(-1.0).alias("val")))
    changes = inner.select(F.explode(steps).alias("s")).select("s.*")
    waiting = running_totals(changes, inner.select("node_id", "hi", F.col("node_id").alias("at")), [])
    return waiting.select((F.col("hi") / 2 - 1 - F.round("total")).cast("int").alias("position"), "node_id")


def subtree_size(tree: DataFrame) -> DataFrame:
    """``node_id, nodes, leafs``: descendants (a leaf counts itself) and leaves below.

    A strictly binary subtree over ``m`` leaves spans ``2m - 1`` ids.
    """
    width = F.col("hi") - F.col("lo")
    return tree.select(
        "node_id", F.when(F.col("is_leaf"), F.lit(1)).otherwise(width).cast("int").alias("nodes"),
        (width / 2 + 1).cast("int").alias("leafs"))


def descendants(tree: DataFrame) -> DataFrame:
    """``node_id, descendant_id``: everything below an internal node, a leaf itself."""
    inside = tree.select("node_id", "is_leaf", "lo", "hi")
    below = interval_join(tree.select(F.col("node_id").alias("pos")), inside).withColumnRenamed("pos", "descendant_id")
    return below.where(F.col("is_leaf") | (F.col("node_id") != F.col("descendant_id"))) \
        .select("node_id", "descendant_id")


def ancestors(tree: DataFrame) -> DataFrame:
    """``node_id, ancestor_id, ancestor_depth, ancestor_dist``: the path to the root, self included."""
    above = tree.select(F.col("node_id").alias("ancestor_id"), F.col("depth").alias("ancestor_depth"), F.col("dist").alias("ancestor_dist"), "lo", "hi")
    return interval_join(tree.select(F.col("node_id").alias("pos")), above).select(
        F.col("pos").alias("node_id"), "ancestor_id", "ancestor_depth", "ancestor_dist")


def leaf_names(tree: DataFrame) -> DataFrame:
    """``node_id, name``: a row for every leaf under every node."""
    inside = tree.select("node_id", "lo", "hi")
    return interval_join(leaves(tree).withColumnRenamed("node_id", "pos"), inside).select("node_id", "name")


def leaf_names_below(tree: DataFrame) -> DataFrame:
    """``node_id, names``: sorted leaf names under every node, for trees of which one row can hold all names."""
    return leaf_names(tree).groupBy("node_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def with_children(tree: DataFrame) -> DataFrame:
    """Add ``left_id`` and ``right_id`` from the parents; in-order ids put the left child first."""
    children = tree.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(
        F.min("node_id").alias("left_id"), F.max("node_id").alias("right_id"))
    return tree.join(children, "node_id", "left")


def largest_genome(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node_id, largest``: largest genome among the leaves below; 0 where none has a sketch.

    ``sizes(name, genome_size)`` gives the genome sizes.
    """
    sized = leaves(tree).join(sizes, "name", "left").select(
        (F.col("node_id") / 2).cast("int").alias("pos"), F.coalesce("genome_size", F.lit(0)).alias("val"))
    spans = tree.select(F.col("node_id").alias("id"), (F.col("lo") / 2).cast("int").alias("lo"), (F.col("hi") / 2).cast("int").alias("hi"))
    top = tree.agg(F.max("hi")).first()[0] // 2 + 1
    return range_maximum(sized, spans, top).select(F.col("id").alias("node_id"), F.col("val").alias("largest"))


def root_distance(tree: DataFrame) -> DataFrame:
    """``node_id, x``: branch lengths summed from the root."""
    steps = F.array(F.struct(F.col("lo").alias("pos"), F.col("dist").alias("val")),
                    F.struct((F.col("hi") + 1).alias("pos"), (-F.col("dist")).alias("val")))
    changes = tree.select(F.explode(steps).alias("s")).select("s.*")
    return running_totals(changes, tree.select("node_id", F.col("node_id").alias("at")), []).select(
        "node_id", F.col("total").alias("x"))


def coordinates(tree: DataFrame, height: float, width: float, leaf_count: int,
                equal_dist: bool = False) -> DataFrame:
    """``node_id, x, y`` of a left-to-right drawing.

    ``x`` is the root distance (or the depth, for equal branch lengths) scaled so
    that the farthest node sits at ``width``.  A leaf's ``y`` is its position
    times the line height; an internal node sits midway between its two children.
    """
    step = height / leaf_count
    ys = midpoints(tree, tree.where("is_leaf").select("node_id", (F.col("node_id") / 2 * F.lit(step)).alias("val"))).withColumnRenamed("val", "y")
    xs = tree.select("node_id", F.col("depth").cast("double").alias("x")) if equal_dist else root_distance(tree)
    top = xs.agg(F.max("x")).first()[0] or 1.0
    return xs.join(ys, "node_id").select("node_id", (F.col("x") / F.lit(top) * F.lit(float(width))).alias("x"), "y")


def uniform_colour(tree: DataFrame, colours: DataFrame) -> DataFrame:
    """``node_id, colour`` for nodes whose leaves all share one colour.

    ``colours(name, colour)`` colours the leaves; one that is left out has a colour of its own kind, none.  A subtree
    is uniform if no leaf in it differs from the one before, so counting such turns is enough.
    """
    coloured = leaves(tree).join(colours, "name", "left").select(F.col("node_id").alias("pos"), "colour")
    after = coloured.select((F.col("pos") + 2).alias("pos"), F.col("colour").alias("__left"))
    changes = coloured.join(after, "pos").select("pos", (~F.col("colour").eqNullSafe(F.col("__left"))).cast("double").alias("val"))
    spans = tree.select("node_id", (F.col("lo") + 1).alias("lo"), F.col("hi"))
    turns = interval_sums(changes, spans, [])
    first = tree.select("node_id", F.col("lo").alias("pos")).join(coloured, "pos")
    return turns.where(F.round("total") == 0).join(first, "node_id").where("colour is not null").select("node_id", "colour")


# --- lowest common ancestors -------------------------------------------------

def _level(width: Column) -> Column:
    """floor(log2(width)); the half keeps exact powers clear of rounding."""
    return F.floor(F.log2(width + F.lit(0.5))).cast("int")


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), level)


def range_minimum(tree: DataFrame) -> DataFrame:
    """``level, start, node_id, depth``: shallowest node of every window of ``2**level`` ids.

    The shallowest node of an id window is the common ancestor of its ends.  A
    node wins exactly the windows that contain it and stay inside its subtree,
    so each node lists its own windows and nothing has to be compared.
    """
    size = _power(F.col("level"))
    levels = tree.select("node_id", "depth", "lo", "hi",
                         F.explode(F.sequence(F.lit(0), _level(F.col("hi") - F.col("lo") + 1))).alias("level"))
    spans = levels.select(
        "level", "node_id", "depth",
        F.greatest(F.col("lo"), F.col("node_id") - size + 1).alias("__from"),
        F.least(F.col("node_id"), F.col("hi") - size + 1).alias("__to"))
    return spans.where("__from <= __to").select(
        "level", F.explode(F.sequence("__from", "__to")).alias("start"), "node_id", "depth")


def lowest_common_ancestor(pairs: DataFrame, tree: DataFrame, small: bool = True) -> DataFrame:
    """Add ``node_id``, the lowest common ancestor of all ids between ``lo_id`` and ``hi_id``.

    Two overlapping windows cover the range, so this is two equi-joins with the
    window table.  A range of one id is its own ancestor and joins nothing.
    ``small`` says the table was checked to fit a broadcast.
    """
    table = range_minimum(tree)
    level = _level(F.col("hi_id") - F.col("lo_id") + 1)
    alone = pairs.where("lo_id = hi_id").select(*pairs.columns, F.col("lo_id").alias("node_id"))
    keyed = pairs.where("lo_id <> hi_id").withColumn("level", level)
    how = "broadcast" if small else "merge"
    left = table.select("level", F.col("start").alias("lo_id"), F.col("node_id").alias("__n1"),
                        F.col("depth").alias("__d1")).hint(how)
    right = table.select("level", F.col("start").alias("__s2"), F.col("node_id").alias("__n2"),
                         F.col("depth").alias("__d2")).hint(how)
    keyed = keyed.withColumn("__s2", F.col("hi_id") - _power(F.col("level")) + 1)
    found = keyed.join(left, ["level", "lo_id"]).join(right, ["level", "__s2"])
    best = F.when(F.col("__d1") <= F.col("__d2"), F.col("__n1")).otherwise(F.col("__n2"))
    return found.select(*pairs.columns, best.alias("node_id")).unionByName(alone)


# --- sums and maxima over ranges of ids ---------------------------------------

#: ids that one window partition of a running sum covers
SPAN = 4096
#: positions of a block of the range maximum
BLOCK = 32


def _span(pos: Column | str) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(SPAN)).cast("int")


def running_totals(points: DataFrame, asks: DataFrame, group: list[str]) -> DataFrame:
    """Add ``total`` to ``asks(group..., at, ...)``: the sum of ``points(group..., pos, val)`` up to ``at``.

    Two levels: sums over the few spans of ``SPAN`` positions before, and a running sum inside the span, which starts
    from them.  No task sees more of a group than one span of it.
    """
    carried = [c for c in asks.columns if c not in (*group, "at")]
    data = points.select(*group, F.col("pos").cast("int").alias("__pos"), F.lit(1).alias("__kind"), F.col("val").cast("double").alias("__val"))
    data = data.withColumn("__span", _span("__pos"))
    asked = asks.select(*group, F.col("at").cast("int").alias("__pos"), F.lit(2).alias("__kind"), F.lit(0.0).alias("__val"), *carried) \
        .withColumn("__span", _span("__pos"))
    sums = data.groupBy(*group, "__span").agg(F.sum("__val").alias("__sum"))
    spans = asked.select(*group, "__span").distinct().join(sums, [*group, "__span"], "full")
    before = Window.partitionBy(*group).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(*group, "__span", (F.col("__span") * SPAN).alias("__pos"), F.lit(0).alias("__kind"),
                         F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__val"))
    inside = Window.partitionBy(*group, "__span").orderBy("__pos", "__kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # the few bases are dealt anew: a union of inputs that share a partitioning expects equal numbers of partitions
    bases = bases.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = asked.unionByName(data, allowMissingColumns=True).unionByName(bases, allowMissingColumns=True)
    return every.withColumn("total", F.sum("__val").over(inside)).where("__kind = 2").select(
        *group, F.col("__pos").alias("at"), *carried, "total")


def interval_sums(points: DataFrame, intervals: DataFrame, group: list[str]) -> DataFrame:
    """``group..., node_id, total``: sum of ``points`` inside every ``intervals(group..., node_id, lo, hi)``.

    Linear in points plus intervals, however deep the tree: the total up to ``hi`` less that before ``lo``.
    """
    ends = F.array(F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")),
                   F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")))
    asks = intervals.select(*group, "node_id", F.explode(ends).alias("e")).select(*group, "node_id", "e.*").where("at >= 0")
    return running_totals(points, asks, group).groupBy(*group, "node_id").agg(
        F.sum(F.col("total") * F.col("sign")).alias("total"))


def cumulative(counts: DataFrame, tree: DataFrame, groups: DataFrame, group: str = "sample") -> DataFrame:
    """``group, node_id, total``: own count plus all counts below, for every node, zeros included.

    ``counts(group, node_id, cnt)`` is sparse; ``groups(group)`` lists the groups.  The nodes of a group are put in
    span by span.
    """
    nodes = tree.agg(F.max("hi")).first()[0] + 1
    # groups times nodes rows on the other side: never let the planner broadcast those
    spans = tree.select("node_id", "lo", "hi", _span("node_id").alias("__s")).hint("broadcast" if nodes <= BROADCAST_ROWS else "merge")
    every = groups.select(group, F.explode(F.sequence(F.lit(0), F.lit((nodes - 1) // SPAN))).alias("__s"))
    points = counts.select(group, F.col("node_id").alias("pos"), F.col("cnt").alias("val"))
    return interval_sums(points, every.join(spans, "__s").drop("__s"), [group])


#: sizes of blocks beyond single ids that hold any int
ALL_SIZES = 7


def sums_below(counts: DataFrame, tree: DataFrame, group: str = "sample") -> DataFrame:
    """``group, node_id, total``: own count plus all counts below, for the nodes that have a count in their subtree.

    The same totals as :func:`cumulative` without its zeros: every count is handed to its ancestors, so the work is that
    of the rows returned and of one look at each node, not groups times nodes.
    """
    points = materialize(counts.select(group, F.col("node_id").cast("long").alias("pos"), "cnt"), "points")
    few = points.count() * (ALL_SIZES + 1) <= BROADCAST_ROWS
    above = interval_join(points, tree.select("node_id", "lo", "hi"), ALL_SIZES if few else SIZES, few)
    return above.groupBy(group, "node_id").agg(F.sum("cnt").cast("double").alias("total"))


def range_maximum(values: DataFrame, ranges: DataFrame, positions: int) -> DataFrame:
    """``id, val``: the largest ``values(pos, val)`` inside each of ``ranges(id, lo, hi)``, for positions from 0 on.

    Ranges inside a block look at its values, longer ones at the largest from ``lo`` to the end of its block and
    from the start of ``hi``'s block; the whole blocks between are a range over the blocks' maxima, and so on.
    """
    found = None
    while True:
        block = F.floor(F.col("pos") / BLOCK)
        line = Window.partitionBy("__b").orderBy("pos")
        edges = values.select("pos", "val", block.alias("__b")).select(
            "pos", F.max("val").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("__head"),
            F.max("val").over(line.rowsBetween(0, Window.unboundedFollowing)).alias("__tail"))
        same = F.floor(F.col("lo") / BLOCK) == F.floor(F.col("hi") / BLOCK)
        short = ranges.where(same).select("id", F.explode(F.sequence("lo", "hi")).alias("pos")).join(values, "pos").select("id", "val")
        wide = ranges.where(~same)
        low = wide.select("id", F.col("lo").alias("pos")).join(edges, "pos").select("id", F.col("__tail").alias("val"))
        high = wide.select("id", F.col("hi").alias("pos")).join(edges, "pos").select("id", F.col("__head").alias("val"))
        part = short.unionByName(low).unionByName(high)
        found = part if found is None else found.unionByName(part)
        if positions <= BLOCK:
            return found.groupBy("id").agg(F.max("val").alias("val"))
        positions = -(-positions // BLOCK)
        ranges = wide.select("id", (F.floor(F.col("lo") / BLOCK) + 1).alias("lo"), (F.floor(F.col("hi") / BLOCK) - 1).alias("hi")).where("lo <= hi")
        values = values.groupBy(block.alias("pos")).agg(F.max("val").alias("val"))
