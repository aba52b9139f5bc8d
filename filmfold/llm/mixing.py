"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold.llm.common import unused, word_count, written

#: Weights dealt to sources in order of name, again and again; the mix's size and a source's most, in sizes.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix"


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 that follows from the row alone: 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2 ** 52))


def quality(text: Column) -> Column:
    """Between 0.5 and 1: half, and half the share of characters that are letters, white space or plain punctuation."""
    length = F.char_length(text)
    odd = length - F.char_length(F.translate(text, "#$%&*+<=>@\\^_`{|}~", ""))
    return F.when(length > 0, 1 - 0.5 * odd / length).otherwise(F.lit(1.0))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of (source, source_size); one row a source.

    Sources by code point, null last, get WEIGHTS in turn. SHARE of all sizes
    is dealt by weight; no source gets more than MOST times its size, and what
    is over goes to the others by weight until none is above. That end point is
    one level L: source i gets the lesser of its most and L times its weight.
    In order of most by weight the capped ones come first, so running sums give
    it in one pass. Sources are as many as the mix names, so one task has them.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * SHARE) \
        .withColumn("weights", F.sum("weight").over(everything)) \
        .withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("total") - F.col("used")) / (F.col("weights") - F.col("gone"))
    rows = rows.withColumn("level", level).withColumn("capped", F.col("most") / F.col("weight") <= F.col("level"))
    # The first source that is not capped sets the level for itself and all after it; theirs come out lower.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(final * F.col("weight"))) \
        .select("source", "source_size", "target")


def order_key(doc_id: Column, weight: Column) -> Column:
    return -F.log(uniform(F.coalesce(doc_id, F.lit(-1)))) / weight


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken of (doc_id, source, size, weight).

    Each document gets the key -ln(u) / weight, u from a digest of its id: the
    order of these keys is a draw without replacement in which the chance to
    come next goes with the weight. A source first takes whole epochs of all its
    documents, then documents in order of key until the rest of its target is
    reached; the one that crosses it is taken if that comes nearer.

    Sizes run up inside range partitions by (source, key), and a partition's
    start is the sum of those before it, so a source with a third of all rows
    is spread over many tasks. The cut of a source is one (key, doc_id), found
    from those sums; whether a document is taken follows from comparing with
    it, row by row.

    Null sources are one source. Rows alike in doc_id, source and weight share a
    key and are taken together. A source of size 0 has target 0 and nothing to take. No
    rows give none.
    """
    key = order_key(F.col("doc_id"), F.col("weight"))
    rows = written(docs.select("doc_id", "source", "size", key.alias("key")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = targets(sizes).withColumn("epochs", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    dealt = written(dealt, "mix-targets")
    ranged = rows.repartitionByRange("source", "key", "doc_id").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "mix-ranges")
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("here"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    # Only the one partition of a source in which its rest is reached needs the sums of its rows.
    crossing = parts.join(dealt.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of"))) \
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("here") > F.col("rest"))) \
        .select("of", F.col("part").alias("in"), "before", "rest")
    crossing = written(crossing, "mix-crossing")
    inside = ranged.join(crossing, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    run = Window.partitionBy("of").orderBy("key", "doc_id")
    upto = F.col("before") + F.sum("size").over(run)
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size"))
    fits = inside.withColumn("upto", upto).filter((F.col("upto") <= F.col("rest")) | (
        (F.col("upto") - F.col("size") < F.col("rest")) & nearer))
    last = fits.groupBy(F.col("of").alias("to")).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    whole = crossing.select("of", "in").join(last, F.col("of").eqNullSafe(F.col("to")), "left").select("of", "in", "last")
    cuts = dealt.join(whole, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("name"), "source_size", "target", "epochs", "in", "last")
    cuts = written(cuts, "mix-cuts")
    joined = ranged.join(cuts, F.col("source").eqNullSafe(F.col("name")))
    in_part = F.coalesce(F.struct("key", "doc_id") <= F.col("last"), F.lit(False))
    picked = (F.col("part") < F.col("in")) | ((F.col("part") == F.col("in")) & in_part)
    times = F.col("epochs") + F.when(F.coalesce(picked, F.lit(False)), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", "epochs",
                         (times * F.col("size")).alias("taken"), times.alias("times"), "key")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and weight of documents, for ``plan``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
                       quality(F.coalesce(F.col("text"), F.lit(""))).alias("weight"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns as they are.

    A row meets its plan by doc_id, source and key, so rows that share a doc_id
    but not the source or the text's quality are each taken as often as their
    own plan says. Null texts have no words, but may come with the documents of
    their source. No rows give none.
    """
    own, of, name, at, times, copy = unused(docs, "own", "of", "name", "at", "times", "copy")
    picked = plan(sized(docs)).filter("times > 0").select(
        F.col("doc_id").alias(of), F.col("source").alias(name), F.col("key").alias(at), F.col("times").alias(times)).distinct()
    key = order_key(F.col("doc_id").cast("long"), quality(F.coalesce(F.col("text"), F.lit(""))))
    out = docs.withColumn(own, key).join(written(picked, "mix-picked"), F.col("doc_id").eqNullSafe(F.col(of))
                                         & F.col("source").eqNullSafe(F.col(name)) & (F.col(own) == F.col(at)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)
