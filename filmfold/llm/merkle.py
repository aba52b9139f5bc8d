"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in built-in functions only.

A line is a paragraph; a paragraph's leaves are its pieces, which end after a
word that ends in a punctuation mark, a digit or one of some letters, and after
characters of three bytes or more whose last byte is one of some, so text
without punctuation or spaces has leaves of a few words or characters, too.
A paragraph's node hashes its leaves, a section's node its paragraphs, the
root the sections. A section ends before a paragraph whose hash starts with 0 or
1, so an edit moves no section border but its own. The fingerprint is the root in
full and the tree below in eight digits a node:

    root/section:paragraph=leaf,leaf|paragraph=leaf;section:...

Equal texts have equal fingerprints; different roots mean different texts, and
the branches that differ say where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold.llm.common import written

#: Read on the UTF-8 bytes of a text, one character a byte: the last byte of a character from another script stands for
#: its code point modulo 64. The full stop and comma of Chinese and Japanese are among the ends.
_WIDE_ENDS = r"\x81\x82\x8C\x93\x9B\xA4\xAD\xB6"
_ODD = "".join(rf"\x{byte:02X}" for byte in range(0x81, 0xC0, 2))
_PIECE_END = (rf"(?<=[.!?,;:0-9adgklmnyADGKLMNY{_ODD}]) "
              rf"|(?<=[\xE0-\xEF][\x80-\xBF][{_WIDE_ENDS}]|[\xF0-\xF4][\x80-\xBF][\x80-\xBF][{_WIDE_ENDS}])(?!\z)")
_SECTION_START = r"\|(?=[01])"


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a column; null counts as empty."""
    octets = F.decode(F.coalesce(F.col(text), F.lit("")).cast("binary"), "ISO-8859-1")
    leaves = F.transform(F.split(octets, "\n", -1), lambda line: F.transform(
        F.split(line, _PIECE_END, -1), lambda piece: _hash(F.encode(piece, "ISO-8859-1"))))
    out = docs.withColumn("_leaves", leaves)
    out = out.withColumn("_nodes", F.transform("_leaves", lambda found: _hash(F.concat_ws(",", found))))
    out = out.withColumn("_sections", F.transform(
        F.split(F.concat_ws("|", "_nodes"), _SECTION_START, -1), _hash))
    shown = F.transform("_leaves", lambda found, i: F.concat(
        _short(F.element_at("_nodes", i + 1)), F.lit("="), F.concat_ws(",", F.transform(found, _short))))
    branches = F.transform(F.split(F.concat_ws("|", shown), _SECTION_START, -1), lambda branch, i: F.concat(
        _short(F.element_at("_sections", i + 1)), F.lit(":"), branch))
    root = _hash(F.concat_ws(";", "_sections"))
    return out.withColumn(name, F.concat(root, F.lit("/"), F.concat_ws(";", branches))) \
        .drop("_leaves", "_nodes", "_sections")


def _branches(fingerprint: Column) -> Column:
    return F.split(F.substring(fingerprint, 66, 2147483647), ";", -1)


def _leaves_of(branches: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(
        branches, lambda b: F.split(F.regexp_replace(b, r"^[^:]*:|[^|,=:]*=", ""), "[|,]", -1))))


def _once(value: Column, body) -> Column:
    """The body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the share of different leaves that two fingerprints have in common, twice those over both counts.

    Equal roots end it; equal sections are counted as they are; only leaves of
    sections that differ are compared.
    """
    def leaves(s: Column) -> Column:
        return F.struct(F.size(_leaves_of(s["same"])).alias("alike"),
                        _leaves_of(F.array_except(s["a"], s["same"])).alias("a"),
                        _leaves_of(F.array_except(s["b"], s["same"])).alias("b"))

    def share(s: Column) -> Column:
        common = s["alike"] + F.size(F.array_intersect(s["a"], s["b"]))
        return 2 * common / (2 * s["alike"] + F.size(s["a"]) + F.size(s["b"])).cast("double")

    both = F.struct(_branches(left).alias("a"), _branches(right).alias("b"))
    value = _once(both, lambda s: _once(
        F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_intersect(s["a"], s["b"]).alias("same")),
        lambda t: _once(leaves(t), share)))
    return F.when(left == right, 1.0).otherwise(value)


def changed_sections(left: Column, right: Column) -> Column:
    """Numbers (from 0) of the left fingerprint's sections that the right one does not have."""
    a, b = _branches(left), _branches(right)
    return F.filter(F.transform(a, lambda x, i: F.when(~F.array_contains(b, x), i)), lambda i: i.isNotNull())


def next_ids(docs: DataFrame, share: int) -> DataFrame:
    """One row for each different doc_id: doc_id, shares, quarter, next_id, next_shares, in ascending order of ids.

    After the last comes the first. Ids alone are range partitioned and numbered
    inside their range; a range's last id goes on with the first of the next
    range, one row a range. No task has more than a range. ``quarter`` is
    floor(n / 4) of the id's longest text; ``shares`` says in how many parts
    of at most about ``share`` rows the id's rows are dealt.
    """
    length = F.char_length(F.coalesce("text", F.lit("")))
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(length / 4).cast("int")).alias("quarter"),
                                     F.ceil(F.count("*") / share).cast("int").alias("shares"))
    ranged = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranged-ids")
    here = F.struct("doc_id", "shares")
    by_part = Window.orderBy("part")
    firsts = ranged.groupBy("part").agg(F.min(F.when(F.col("doc_id").isNotNull(), here)).alias("first"))
    firsts = firsts.select("part", F.coalesce(
        F.lead("first").over(by_part), F.min("first").over(Window.partitionBy())).alias("onward"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    found = ranged.withColumn("inside", F.lead(here).over(inside)).join(firsts, "part")
    after = F.coalesce("inside", "onward")
    return found.select("doc_id", "shares", "quarter", after["doc_id"].alias("next_id"),
                        F.coalesce(after["shares"], F.lit(1)).alias("next_shares"))


def _keys(doc_id: Column, shares: Column) -> list[Column]:
    """Columns key, none and salt, none of them null: a row for each share of the id."""
    return [F.coalesce(doc_id, F.lit(0)).alias("key"), doc_id.isNull().alias("none"),
            F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt")]


def edited_pairs(docs: DataFrame, share: int = 100_000) -> DataFrame:
    """Fingerprints of every text and of an edit of it.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. In the edit the last quarter of the text gives way
    to as many first characters (or all) of the next document's.

    Texts are shuffled once, by id: the same shuffle gives a text to the join
    that tells it its predecessor and to the one that brings it its successor.
    (The join columns are never null, so neither join filters its input and
    both inputs are one.) What a predecessor gets is a quarter's length of the text and the
    fingerprint. An id with more than ``share`` rows is dealt over several
    tasks by the place of its rows in the input.

    Null texts count as empty. Among rows that share a doc_id the next document
    is the one whose first characters are smallest; each row has its own
    result. A null doc_id is followed by the smallest id and follows none,
    unless all are null: then they are their own next. A document alone is its
    own next. No rows give none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    links = written(next_ids(docs, share), "next-ids")
    shared = written(links.filter("shares > 1").select(F.col("doc_id").alias("shared_id"), "shares"), "shared-ids")
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    texts = placed.join(shared, F.col("doc_id").eqNullSafe(F.col("shared_id")), "left").select(
        F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.pmod("place", F.coalesce("shares", F.lit(1))).cast("int"), F.lit(0)).alias("salt"), "text")
    ahead = links.select(F.col("doc_id").alias("before"), "shares", "quarter",
                         *_keys(F.col("next_id"), F.col("next_shares")))
    heads = with_fingerprint(texts.join(ahead, ["key", "none", "salt"])).select(
        *_keys(F.col("before"), F.col("shares")), F.expr("substring(text, 1, quarter)").alias("head"),
        F.col("fingerprint").alias("next_fingerprint"))
    heads = heads.groupBy("key", "none", "salt").agg(F.min(F.struct("head", "next_fingerprint")).alias("next"))
    out = texts.join(heads, ["key", "none", "salt"], "left")
    out = out.withColumn("n_chars", F.char_length("text").cast("long")) \
        .withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    out = out.withColumn("edited", F.expr(
        "concat(substring(text, 1, cast(n_chars as int) - cut), substring(coalesce(next.head, ''), 1, cut))"))
    out = with_fingerprint(with_fingerprint(out), "edited", "edited_fingerprint")
    empty = F.concat(_hash(F.lit("")), F.lit("/"))
    return out.select(
        F.when(~F.col("none"), F.col("key")).alias("doc_id"), "n_chars",
        _hash(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next.next_fingerprint", empty)).alias("near_next"))
