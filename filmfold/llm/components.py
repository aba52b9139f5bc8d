"""Distributed union-find: connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmfold.llm.common import written


def scrambled(node: Column) -> Column:
    """A one-to-one reordering of longs, so that chains of ids do not shrink by one node a round."""
    for _ in range(3):
        node = node.bitwiseXOR(F.shiftleft(node, 13))
        node = node.bitwiseXOR(F.shiftrightunsigned(node, 7))
        node = node.bitwiseXOR(F.shiftleft(node, 17))
    return node


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour in scrambled order
    and rewrites the links between the hooks, so nodes fall by a constant share
    a round. A round is one aggregate and two joins over links that are left;
    the trees of all rounds are composed as they arise. Every round's tables
    are files in the shared folder. Loops and nulls are left out; no links give
    no rows.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    left = written(pairs.select(scrambled(F.col("a")).alias("a"), scrambled(F.col("b")).alias("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    roots = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct() \
        .withColumn("root", scrambled(F.col("node")))
    roots = written(roots, "cc-roots")
    while not left.isEmpty():
        hook = written(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "cc-hooks")
        ends = [hook.select(F.col("node").alias(e), F.col("to").alias(f"{e}_to")) for e in ("a", "b")]
        moved = left.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        left = written(moved.filter("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
        roots = written(roots.join(hook, F.col("root") == hook.node, "left").select(
            roots.node, F.coalesce("to", "root").alias("root")), "cc-roots")
    lowest = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(lowest, "root").select("node", "component")


def extended(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (node, component) after further links (a, b), again with the smallest node as component.

    Links are moved to the groups they join and only those are contracted, so
    the work follows the new links. No links leave the groups as they are.
    """
    if links.isEmpty():
        return groups
    ends = [groups.select(F.col("node").alias(e), F.col("component").alias(f"{e}_of")) for e in ("a", "b")]
    moved = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    over = written(components(moved), "cc-over")
    known = groups.join(over.select(F.col("node").alias("component"), F.col("component").alias("onward")), "component",
                        "left").select("node", F.coalesce("onward", "component").alias("component"))
    return written(known.union(over.join(groups, "node", "left_anti").select("node", "component")), "cc-groups")
