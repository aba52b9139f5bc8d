"""Merkle manifest of a dataset: a tree of eight over each language's documents, proofs and folding by superblock."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold.llm.common import written

#: Nodes that become one, and levels that one superblock reduces: it holds RUN ** LEVELS leaves.
RUN, LEVELS = 8, 3
BLOCK = RUN ** LEVELS

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sha(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its UTF-8 length before it, so that no two rows share an input."""
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
        for f in (f.cast("string") for f in fields)
    ]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text as a tampered copy has it: lower-cased in A-Z where 3 divides the id's checksum. Null ids are left alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """grp, doc_id, leaf, changed: the digest of each row, and that of its tampered copy if it differs.

    ``grp`` is the language in a form that sorts as its bytes do, null first.
    """
    plain = [F.col(c) for c in FIELDS]
    other = leaf([*plain[:-1], tampered_text(F.col("doc_id"), F.col("text"))])
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(plain).alias("leaf"),
                       other.alias("changed")).withColumn("changed", F.nullif("changed", "leaf"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place in its grp by the order, and ``n``, the rows of the grp.

    Rows are range partitioned by group and order, so a large group is many
    tasks; a row's place is that in its task plus the rows of earlier tasks, a
    table of one row for each task and group.
    """
    place = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("place", place)
    ordered = written(ordered, "manifest-ordered").withColumn("part", F.shiftright("place", 33))
    parts = ordered.groupBy("grp", "part").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0))).withColumn(
        "n", F.sum("here").over(Window.partitionBy("grp")))
    parts = written(parts.select("grp", "part", (F.col("before") - F.col("least")).alias("shift"), "n"), "manifest-parts")
    return ordered.join(parts, ["grp", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop(
        "part", "place", "shift")


def nodes_at(n: int, level: int) -> int:
    """Nodes of a tree of n leaves at a level."""
    return -(-n // RUN ** level)


def reduce_block(digests: list[str], n: int, level: int) -> list[list[str]]:
    """The levels of a superblock from its first nodes on, as far as the tree has several nodes in all."""
    out = [digests]
    for up in range(LEVELS):
        if nodes_at(n, level + up) <= 1:
            break
        low = out[-1]
        out.append([_sha(low[i:i + RUN]) for i in range(0, len(low), RUN)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The siblings, joined, left and right of leaf i and its ancestors inside the superblock."""
    steps = []
    for low in levels[:-1]:
        first = i // RUN * RUN
        steps.append(("".join(low[first:i]), "".join(low[i + 1:first + RUN])))
        i //= RUN
    return steps


def fold(digest: str, steps: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        digest = _sha((left, digest, right))
    return digest


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def _up(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def root(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        top = reduce_block(list(block["digest"]), int(block["n"].iloc[0]), level)[-1]
        return block.head(1)[["grp", "n"]].assign(pos=block["block"].iloc[0], digest=top)

    return root


def _down(level: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def paths(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        inside, above = reduce_block(list(block["digest"]), int(block["n"].iloc[0]), level), outer.iloc[0]
        tail = [(s["left"], s["right"]) for s in above["steps"]]
        steps = [[{"left": a, "right": b} for a, b in [*path_of(inside, i), *tail]] for i in range(len(block))]
        return pd.DataFrame({"grp": block["grp"], "block": block["pos"], "subroot": above["subroot"],
                             "root": above["root"], "steps": pd.Series(steps, index=block.index)})

    return paths


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """grp, n, pos, digest of the leaves, of the superblocks' roots, of their superblocks' roots, and so on up to one a grp.

    A group handed to a task is one superblock, never more than BLOCK rows.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    found, level = [nodes], 0
    while nodes_at(most, level) > 1:
        above = _with_block(found[-1].select("grp", "n", "pos", "digest")).groupBy("grp", "block").applyInPandas(
            _up(level), "grp string, n long, pos long, digest string")
        found.append(written(above, "manifest-tier"))
        level += LEVELS
    return found


_STEP = "array<struct<left:string,right:string>>"


def outer_nodes(levels: list[DataFrame], top: DataFrame, lowest: int = 1) -> DataFrame:
    """grp, block, subroot, root, steps: the siblings of each superblock's ancestors, level by level up to the root.

    ``top``: the same for the one node that a grp has in the highest of the
    tiers, as block 0. From there down, the nodes of a superblock meet its outer
    nodes, and each passes on its own siblings and these. ``lowest`` 0 goes on
    to the leaves themselves.
    """
    for depth in reversed(range(lowest, len(levels) - 1)):

        nodes = _with_block(levels[depth].select("grp", "n", "pos", "digest"))
        top = written(nodes.groupBy("grp", "block").cogroup(top.groupBy("grp", "block")).applyInPandas(
            _down(LEVELS * depth), f"grp string, block long, subroot string, root string, steps {_STEPS}"), "manifest-outer")
    return top


_STEPS = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Leaves ascend by doc_id inside their language, eight nodes become one until
    one is left, and the languages' subroots, ordered by name, likewise give the
    root. The proof is the digest of all siblings from leaf to root;
    folded_root starts from the tampered leaf where the row is tampered with.

    Leaves are digested where their rows are read; only digests are shuffled.
    They and the outer nodes that they need are cogrouped by superblock (at most
    512 leaves, at any size of a language), where one call reduces the leaves,
    joins the proofs and folds them.

    Null doc_ids come first in their language, null languages form one of their
    own, rows alike in doc_id are ordered by digest, repeated rows are leaves of
    their own, null fields digest as such, other columns are ignored, and no
    rows give none.
    """
    found = numbered(written(leaves(docs), "manifest-leaves"), ["doc_id", "leaf"])
    found = written(_with_block(found.withColumnRenamed("leaf", "digest")), "manifest-places")
    by_lang = tiers(found)
    langs = by_lang[-1].select(F.col("grp").alias("lang"), F.lit("").alias("grp"), "digest")
    langs = written(numbered(langs, ["lang"]), "manifest-langs")
    over = tiers(langs)
    first, none = F.lit(0).cast("long").alias("block"), F.expr(f"cast(array() as {_STEPS})").alias("steps")
    root = over[-1].select("grp", first, F.lit("").alias("subroot"), F.col("digest").alias("root"), none)
    above = outer_nodes(over, written(root, "manifest-root"), lowest=0).select(F.col("block").alias("pos"), "root", "steps")
    top = langs.join(above, "pos").select(
        F.col("lang").alias("grp"), first, F.col("digest").alias("subroot"), "root", "steps")
    outer = outer_nodes(by_lang, written(top, "manifest-top"))
    places = found.withColumn("doc_id", F.col("doc_id").cast("string"))  # nulls would make floats of numbers
    return places.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(
        _finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                 "verified boolean").withColumn("doc_id", F.col("doc_id").cast("long"))


def _finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    digests, above = list(block["digest"]), outer.iloc[0]
    inside = reduce_block(digests, int(block["n"].iloc[0]), 0)
    tail = [(s["left"], s["right"]) for s in above["steps"]]
    rest = "".join(a + b for a, b in tail)
    proofs, folded = [], []
    for i, (own, changed) in enumerate(zip(digests, block["changed"])):
        steps = path_of(inside, i)
        proofs.append(_sha([*(a + b for a, b in steps), rest]))
        folded.append(fold(changed or own, [*steps, *tail]))
    return pd.DataFrame({"doc_id": block["doc_id"].to_numpy(), "leaf": digests, "subroot": above["subroot"],
                         "root": above["root"], "proof_sha256": proofs, "folded_root": folded,
                         "verified": [f == above["root"] for f in folded]})
