"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmergrid.session import materialize

#: samples of a fingerprint; the likeness of two is off by 1 / (2 * sqrt(SAMPLES)) at most, in standard deviations
SAMPLES = 48

#: samples that one row works out, so that a hash table is asked once for all of them; the JVM does not compile methods of
#: more than 8,000 bytes, which eight at once would take
_AT_ONCE = 4

_BITS = 21


def _uniform(bits: Column, part: int) -> Column:
    """A number inside (0, 1) from one of three groups of 21 bits."""
    return (F.shiftrightunsigned(bits, part * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)) + 0.5) / float(1 << _BITS)


#: tells texts apart: whether the row has an id, the id (0 for none) and a hash of the text
_KEY = ["known", "id", "text_key"]


def samples(weights: DataFrame, count: int = SAMPLES) -> DataFrame:
    """The samples of two sets of weighted terms per document: its key, ``own, edited``, ``count`` longs for each set.

    ``weights(known, id, text_key, term, own, edited)`` has a weight for each term and set, 0 for none.  For every term and sample
    two gamma(2, 1) numbers ``r`` and ``c`` and a uniform ``b`` come from hashes; with ``t = floor(ln w / r + b)`` the
    term with the least ``ln c - r * (t - b) - r`` is drawn, together with ``t``.  Two sets of weights draw the same
    with the probability of their generalised Jaccard similarity, the sum of minima over the sum of maxima.

    The drawn value is packed into a long, its order above and a hash of (term, k, t) below, so that a plain minimum
    finds it.  A term that weighs the same in both sets is drawn once for both.
    """
    def entry(weight: str, own: bool, edited: bool) -> Column:
        return F.struct(F.col(weight).alias("w"), F.lit(own).alias("in_own"), F.lit(edited).alias("in_edited"))

    entries = F.when(F.col("own") == F.col("edited"), F.array(entry("own", True, True))).otherwise(
        F.array(entry("own", True, False), entry("edited", False, True)))
    runs = range(_AT_ONCE)
    drawn = (weights.select(*_KEY, "term", F.explode(entries).alias("e")).select(*_KEY, "term", "e.*").where("w > 0")
             .withColumn("_log", F.log("w")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // _AT_ONCE))))
             .withColumns({f"_h{j}": F.xxhash64("term", F.col("g") * _AT_ONCE + j) for j in runs})
             .withColumns({f"_i{j}": F.xxhash64(f"_h{j}") for j in runs})
             .withColumns({f"_r{j}": -F.log(_uniform(F.col(f"_h{j}"), 0) * _uniform(F.col(f"_h{j}"), 1)) for j in runs})
             .withColumns({f"_b{j}": _uniform(F.col(f"_h{j}"), 2) for j in runs})
             .withColumns({f"_t{j}": F.floor(F.col("_log") / F.col(f"_r{j}") + F.col(f"_b{j}")) for j in runs}))

    def draw(j: int) -> Column:
        h, i, r, b, t = (F.col(f"_{x}{j}") for x in "hirbt")
        c = F.log(-F.log(_uniform(i, 0) * _uniform(i, 1)))
        order = F.floor((c - r * (t - b) - r + 128.0) * float(1 << 23)).cast("long")
        seal = h.bitwiseXOR(t * 2654435769).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(order, 32).bitwiseOR(seal)

    least = (drawn.withColumns({f"_draw{j}": draw(j) for j in runs}).groupBy(*_KEY, "g")
             .agg(*(F.min(F.when(F.col(f"in_{x}"), F.col(f"_draw{j}"))).alias(f"{x}{j}") for x in ("own", "edited") for j in runs)))
    parts = F.sort_array(F.collect_list(F.struct("g", *(F.array(*(f"{x}{j}" for j in runs)).alias(x) for x in ("own", "edited")))))
    return least.groupBy(*_KEY).agg(parts.alias("s")).select(
        *_KEY, *(F.slice(F.flatten(f"s.{x}"), 1, count).alias(x) for x in ("own", "edited")))


def neighbours(texts: DataFrame) -> DataFrame:
    """The ``texts(known, id, text_key, n, ...)`` in descending order of their key as a ring, so those without an id come last.

    Adds ``node``, a number of its own for each, and ``next`` and ``before``, structs of the neighbours' key, ``n`` and
    ``node``.  Keys are dealt by ranges; inside a range a window finds the neighbours, and the ranges' edges, a row for
    each range, are linked in the same way.
    """
    dealt = materialize(texts.repartitionByRange(*_KEY).withColumn("_part", F.spark_partition_id())
                        .withColumn("node", F.monotonically_increasing_id()), "ring")
    downwards = [F.desc(c) for c in _KEY]
    inside = Window.partitionBy("_part").orderBy(*downwards)
    one = F.struct(*_KEY, "n", "node")
    edges = dealt.groupBy("_part").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    around = Window.orderBy(F.desc("_part"))
    ends = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("_part", F.coalesce(F.lead("high").over(around), F.first("high").over(ends)).alias("_next"),
                         F.coalesce(F.lag("low").over(around), F.last("low").over(ends)).alias("_before"))
    near = (dealt.withColumn("_up", F.lag(one).over(inside)).withColumn("_down", F.lead(one).over(inside))
            .join(edges, "_part"))
    return near.select(*dealt.columns, F.coalesce("_down", "_next").alias("next"), F.coalesce("_up", "_before").alias("before")).drop("_part")


def _hex(sample: Column) -> Column:
    return F.lpad(F.lower(F.hex(sample.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def fingerprints(docs: DataFrame, count: int = SAMPLES) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Terms are the words (runs between white space) in lower case, weighted by how often they occur.  The edited text
    has its last third replaced by the beginning of the next document in descending order of id, after the
    last one the first.  Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; likeness is the share of equal samples.

    Equal texts have equal fingerprints.  A null text is an empty one; a text without words has the fingerprint of
    zeros, which is like itself (1) and nothing else (0).  Every row has its row in the result.  Rows that share an id
    are ordered by a hash of their texts and rows without an id come after all others; rows that share id and text
    have one place in the order.  A single document is its own next.
    """
    given = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                        F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    ids = given.groupBy(*_KEY).agg(F.max(F.length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("rows"))
    ring = materialize(neighbours(ids), "ring")
    texts = given.groupBy(*_KEY).agg(F.min("text").alias("text"))
    whole = texts.join(ring, _KEY)
    heads = whole.select(*(F.col(f"before.{c}").alias(c) for c in _KEY), F.expr("substring(text, 1, cast(before.n div 3 as int))").alias("head"))
    # dealt by their keys once, the texts' words, weights and samples stay where the texts are
    both = (whole.select(*_KEY, "text", "n").join(heads, _KEY)
            .select(*_KEY, "text", F.concat(F.expr("substring(text, 1, cast(n - n div 3 as int))"), "head").alias("edited")))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    words = (both.select(*_KEY, kinds.alias("t"))
             .select(*_KEY, "t.kind", F.explode(F.split(F.lower("t.text"), r"\s+")).alias("word")).where("word <> ''"))
    weights = (words.groupBy(*_KEY, F.xxhash64("word").alias("term"))
               .agg(F.sum(1 - F.col("kind")).cast("double").alias("own"), F.sum("kind").cast("double").alias("edited")))
    drawn = samples(weights, count)
    seal = both.select(*_KEY, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))

    def of(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.array_join(F.transform(name, lambda x: _hex(F.coalesce(x, F.lit(0)))), "")).otherwise("0" * 8 * count)

    places = ring.select(*_KEY, F.col("node").alias("doc_id"), F.when(F.col("known"), F.col("id")).alias("given_id"), "n", "rows", F.col("next.node").alias("next_id"))
    made = materialize(places.join(seal, _KEY).join(drawn, _KEY, "left").select(
        "doc_id", "given_id", F.col("n").alias("n_chars"), "rows", "next_id", "edited_sha256", of("own").alias("fingerprint"), of("edited").alias("edited_fingerprint")), "fingerprints")
    following = made.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("_next"))
    found = made.join(following, "next_id").select(
        F.col("given_id").alias("doc_id"), "rows", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", count).alias("near_edited"), likeness("fingerprint", "_next", count).alias("near_next"))
    return found.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")


def likeness(a: str, b: str, count: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common."""
    same = [(F.substring(a, 1 + 8 * k, 8) == F.substring(b, 1 + 8 * k, 8)).cast("int") for k in range(count)]
    return sum(same[1:], same[0]) / float(count)
