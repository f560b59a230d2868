"""Newick lines to tree tables with joins and sums: any number of trees, one a line, none of them read by the driver.

A line is cut into tokens; the running sum of its brackets is the depth of each token; the brackets of one depth are
numbered by a running count, which gives an opening and a closing bracket of a pair the same number and a token the
pair that it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import renumber
from ..operators.tree import running_totals
from ..session import materialize

#: what can be wrong with a line, in the order in which it is reported
PROBLEMS = ("a tree must read '(...);' without a root label", "unbalanced parentheses", "branch without a length", "more than one length",
            "labels on internal nodes are not supported", "leaf without a name", "not a binary tree", "leaf names must be unique")


def _problem(of: Column, number: int) -> Column:
    return F.when(of, F.lit(number))


def _tokens(lines: DataFrame) -> DataFrame:
    """``tree, pos, tok``: brackets, commas and labels in order, from position 1 on."""
    body = F.regexp_extract_all(F.expr("substring(text, 1, length(text) - 1)"), F.lit(r"([(),]|[^(),]+)"), F.lit(1))
    return lines.select("tree", F.posexplode(F.filter(body, lambda t: F.trim(t) != "")).alias("pos", "tok")).withColumn("pos", F.col("pos") + 1)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links, problems)`` of ``lines(tree, text)``.

    ``links(tree, parent, child, side, name, dist)`` are the branches of the well-formed lines, for
    :func:`~kmergrid.operators.numbering.renumber`; ``problems(tree, problem)`` has a row for every other line.  The rules are
    those of a single tree file: strictly binary, names and lengths on leaves, lengths alone on inner branches (0 where
    there is none), the second child on the left.
    """
    given = lines.select("tree", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text"))
    framed = F.col("text").startswith("(") & F.col("text").endswith(");")
    bad = [given.where(~framed).select("tree", F.lit(0).alias("problem"))]
    tokens = materialize(_tokens(given.where(framed)), "tokens")
    turn = F.when(F.col("tok") == "(", F.lit(1)).when(F.col("tok") == ")", F.lit(-1)).otherwise(F.lit(0))
    brackets = tokens.where("tok in ('(', ')')").select("tree", "pos", turn.alias("val"))
    deep = running_totals(brackets, tokens.select("tree", F.col("pos").alias("at"), "tok"), ["tree"])
    after = F.round("total").cast("int")
    # a closing bracket belongs to the depth that it closes
    deep = materialize(deep.select("tree", F.col("at").alias("pos"), "tok", after.alias("after"), (after + (F.col("tok") == ")").cast("int")).alias("level")), "depths")
    ends = deep.groupBy("tree").agg(F.max("pos").alias("last"), F.min("after").alias("least"), F.max_by("after", "pos").alias("open"),
                                    F.min(F.when(F.col("after") < 1, F.col("pos"))).alias("closed"))
    bad.append(ends.where("least < 0 or open != 0 or closed < last").select("tree", F.lit(1).alias("problem")))
    sound = deep.join(bad[1].select("tree"), "tree", "left_anti")

    opens = sound.where("tok = '('").select("tree", "level", "pos", F.lit(1).alias("val"))
    label = ~F.col("tok").isin("(", ")", ",")
    asks = sound.where("tok != ','").select("tree", "level", F.col("pos").alias("at"), "tok", F.lit(False).alias("upper")).unionByName(
        sound.where("tok = '(' and level > 1").select("tree", (F.col("level") - 1).alias("level"), F.col("pos").alias("at"), "tok", F.lit(True).alias("upper")))
    pair = F.concat_ws(".", F.col("level").cast("string"), F.round("total").cast("long").cast("string"))
    placed = materialize(running_totals(opens, asks, ["tree", "level"]).select("tree", F.col("at").alias("pos"), "tok", "upper", pair.alias("pair")), "pairs")
    own = placed.where(~F.col("upper"))
    before = own.where("tok = ')'").select("tree", (F.col("pos") + 1).alias("pos"), F.col("pair").alias("closes"))
    labels = own.where(label).join(before, ["tree", "pos"], "left").withColumn("text", F.trim("tok")).select(
        "tree", "pos", "pair", "closes", F.col("text").contains(":").alias("colon"), F.regexp_extract("text", r"^([\s\S]*):[^:]*$", 1).alias("name"),
        F.abs(F.expr("try_cast(trim(regexp_extract(text, ':([^:]*)$', 1)) as double)")).alias("dist"))
    labels = materialize(labels, "labels")
    inner = F.col("closes").isNotNull()
    wrong = F.coalesce(_problem(~F.col("colon"), 2), _problem(F.col("name").contains(":"), 3), _problem(inner & (F.col("name") != ""), 4), _problem(~inner & (F.col("name") == ""), 5),
                       _problem(F.col("dist").isNull(), 2))
    bad.append(labels.select("tree", wrong.alias("problem")).where("problem is not null"))

    branches = placed.where("tok = '(' and not upper").select("tree", "pos", F.col("pair").alias("child")).join(
        placed.where("upper").select("tree", "pos", F.col("pair").alias("parent")), ["tree", "pos"]).join(
        labels.where(inner).select("tree", F.col("closes").alias("child"), "dist"), ["tree", "child"], "left").select(
        "tree", "parent", "child", "pos", F.lit(None).cast("string").alias("name"), F.coalesce("dist", F.lit(0.0)).alias("dist"))
    tips = labels.where(~inner).select("tree", F.col("pair").alias("parent"), F.col("pos").cast("string").alias("child"), "pos", "name", "dist")
    children = materialize(branches.unionByName(tips), "children")
    kids = children.groupBy("tree", "parent").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("second"))
    pairs = own.where("tok = '('").select("tree", F.col("pair").alias("parent"))
    bad.append(pairs.join(kids, ["tree", "parent"], "left").where("n is null or n != 2").select("tree", F.lit(6).alias("problem")))
    bad.append(children.where("name is not null").groupBy("tree", "name").count().where("count > 1").select("tree", F.lit(7).alias("problem")))

    first = bad[0]
    for b in bad[1:]:
        first = first.unionByName(b)
    first = materialize(first.groupBy("tree").agg(F.min("problem").alias("problem")), "problems")
    links = children.join(kids, ["tree", "parent"]).join(first.select("tree"), "tree", "left_anti").select(
        "tree", "parent", "child", F.when(F.col("pos") == F.col("second"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "name", "dist")
    return links, first.select("tree", F.get(F.array(*map(F.lit, PROBLEMS)), F.col("problem")).alias("problem"))


def read_trees(lines: DataFrame) -> DataFrame:
    """Tree tables of all well-formed ``lines(tree, text)``, with ``tree`` in front."""
    return renumber(parse_lines(lines)[0]).drop("key")
