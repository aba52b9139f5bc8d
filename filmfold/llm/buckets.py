"""Candidate pairs out of shared buckets, without listing all pairs of a group.

A bucket holds the items that share a key (a rare shingle, a band of a
signature). ``shared`` keeps buckets of two and more and gives each a hub,
its first item in one global order. Comparing items with their hubs links large
groups of copies in as many steps as they have members. What the hubs did not
bring together is compared in ``cross_pairs``: buckets are cut by size into
blocks, blocks whose sizes can still match form a tile, and a tile's pairs pass
only if their bitmaps allow the overlap. Of buckets with the same items
``distinct_buckets`` keeps one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmfold.llm.common import folded

#: Items in a block; two blocks are one tile, held in memory by one task. An item of more elements counts once for
#: each so many, as its bitmap is wider.
BLOCK, BLOCK_ELEMENTS = 512, 1 << 15


def shared(rows: DataFrame, few_hubs: bool = True) -> DataFrame:
    """Of (key, id, n): the rows of buckets with two or more different ids, with their hub (hub, hub_n).

    One shuffle by key; the window keeps one row in memory at a time, however
    large a bucket is. With ``few_hubs`` the hub follows one order over all ids,
    so that items which share very many keys meet in few hubs; else each bucket
    has an order of its own, and items that share a few keys meet in as many.
    """
    order = Window.partitionBy("key").orderBy("turn", "id")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("turn", F.xxhash64("id") if few_hubs else F.xxhash64("id", "key"))
        .withColumn("hub", F.first("id").over(sofar)).withColumn("hub_n", F.first("n").over(sofar))
        .withColumn("after", F.lead("id").over(order))
        .filter("hub <> id or after <> id").select("key", "id", "n", "hub", "hub_n")
    )


def hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of each item and its hub whose sizes allow the similarity."""
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    return members.filter("id <> hub").filter(fits).select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def bitmap_filter(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Keep pairs (a, b) whose wide bitmaps (items: id, n, wide) leave room for the overlap.

    A wide bitmap has about a bit per element, so it tells sets of any size
    apart at a sixty-fourth of their arrays. The wider of two is folded to the
    other's width, which keeps the bound.
    """
    left = items.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("w_a"))
    right = items.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("w_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = _differing(batch["w_a"], batch["w_b"])
            keep = _room(differ, batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "w_a", "w_b") \
        .mapInArrow(check, "a long, b long")


#: 64-bit words of bitmaps that are laid side by side at once.
WORDS_AT_ONCE = 1 << 19


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of binaries of whole words: all words, and where each value starts and how many it has."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) // 8
    words = np.frombuffer(data, np.uint64, count=ends[-1]) if data is not None and ends[-1] else np.empty(0, np.uint64)
    return words, ends[:-1], np.diff(ends)


def _differing(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Bits in which the parity bitmaps of each row differ, those of one pair of widths together."""
    (x, x_at, x_wide), (y, y_at, y_wide) = _words(left), _words(right)
    differ = np.zeros(len(left), np.int64)
    for a, b in np.unique(np.column_stack([x_wide, y_wide]), axis=0):
        alike = np.flatnonzero((x_wide == a) & (y_wide == b))
        step = max(1, WORDS_AT_ONCE // max(1, int(a + b)))
        for start in range(0, len(alike), step):
            rows = alike[start:start + step]
            one = folded(x[x_at[rows] + np.arange(a)[:, None]], min(a, b))
            two = folded(y[y_at[rows] + np.arange(b)[:, None]], min(a, b))
            differ[rows] = np.bitwise_count(one ^ two).sum(axis=0, dtype=np.int64)
    return differ


def _room(differ, n_a, n_b, percent: int):
    """100 * overlap >= percent * union is possible: overlap is at most (n_a + n_b - bits that differ) / 2."""
    total = n_a + n_b
    overlap = np.minimum((total - differ) // 2, np.minimum(n_a, n_b))
    return 100 * overlap >= percent * (total - overlap)


def unsettled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, id, n, grp) of the buckets that still hold items of more than one group."""
    known = members.select("key", "id", "n").join(groups, F.col("id") == F.col("node"), "left") \
        .select("key", "id", "n", F.coalesce("component", "id").alias("grp"))
    by_key = Window.partitionBy("key")
    return known.withColumn("low", F.min("grp").over(by_key)).withColumn("high", F.max("grp").over(by_key)) \
        .filter("low <> high").select("key", "id", "n", "grp")


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """Rows (key, id, ...) of one of all buckets that hold the very same ids: the others bring the same pairs again.

    Items that share a passage share a bucket for each of its shingles. Buckets
    are told apart by their number of rows and 128 bits of hashes of their ids,
    added up in halves, so that no sum overflows.
    """
    halves = []
    for seed in range(2):
        hashed = F.xxhash64("id", F.lit(seed))
        halves += [hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)]
    held = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(h).alias(f"half_{i}") for i, h in enumerate(halves)])
    kept = held.groupBy(*[c for c in held.columns if c != "key"]).agg(F.min("key").alias("key")).select("key")
    return rows.join(kept, "key", "left_semi")


def neighbour_pairs(members: DataFrame, groups: DataFrame, percent: int, reach: int = 4, few: bool = False) -> DataFrame:
    """Distinct (a, b) of each item and the next few of its bucket, in an order of the bucket's own, across groups.

    In a group of copies that are mostly, not always, like each other this
    links nearly all that the hubs did not, in steps that grow with the rows.
    With ``few`` all buckets have one order, so that items which share very many
    keys meet the same few neighbours in each.
    """
    turn = F.xxhash64("id") if few else F.xxhash64("key", "id")
    order = Window.partitionBy("key").orderBy(turn, "id")
    rows = unsettled(members, groups).withColumn("own", F.struct("id", "n", "grp"))
    ahead = [F.lead("own", k).over(order) for k in range(1, reach + 1)]
    rows = rows.withColumn("ahead", F.array_compact(F.array(*ahead))).withColumn("other", F.explode("ahead"))
    n, other_n = F.col("n"), F.col("other.n")
    fits = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent
    return rows.filter("other.grp <> grp").filter(fits).select(
        F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct()


def cross_pairs(members: DataFrame, groups: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, lie in different groups and pass size and bitmap bounds.

    ``groups`` (node, component) holds what is linked so far; an item without a
    row is its own group. Buckets of one group need no look. Large buckets are
    cut into blocks in order of size; a tile is a pair of blocks whose sizes
    overlap, so each task holds two blocks whatever the bucket's size.

    ``items`` has id and bitmap. Bitmaps may differ in width; with about a bit
    per element they tell unlike sets of any size apart, while those of a fixed
    width are full of large sets and let all their pairs pass.
    """
    by_size = Window.partitionBy("key").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.sum(F.ceil(F.col("n") / BLOCK_ELEMENTS)).over(by_size)
    placed = unsettled(members, groups).withColumn("block", F.floor((room - 1) / BLOCK).cast("int")) \
        .select("key", "id", "n", "grp", "block")
    blocks = placed.groupBy("key", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = blocks.select("key", F.col("block").alias("other"), F.col("least").alias("o_least"))
    tiles = blocks.join(other, "key").filter(F.col("other") >= F.col("block")) \
        .filter(F.col("most") * 100 >= F.col("o_least") * percent).select("key", "block", "other")
    sides = tiles.select("key", F.col("block").alias("of"), "block", "other").union(
        tiles.filter("other <> block").select("key", F.col("other").alias("of"), "block", "other"))
    dealt = placed.withColumnRenamed("block", "of").join(sides, ["key", "of"]) \
        .join(items.select("id", "bitmap"), "id") \
        .select("key", "block", "other", "of", "id", "n", "grp", "bitmap") \
        .repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "n", "id")
    return dealt.mapInArrow(_tile_pairs(percent), "a long, b long").distinct()


def _tile_pairs(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = _run_starts(held)
            cut = starts[-1]  # the last tile may go on in the next batch
            if cut:
                yield from _pairs(held.slice(0, cut).combine_chunks(), percent)
                held = held.slice(cut)
        if held is not None:
            yield from _pairs(held.combine_chunks(), percent)

    return run


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy()


def _run_starts(rows: pa.Table) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("key", "block", "other"):
        values = _column(rows, name)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _pairs(rows: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """All pairs of each tile that differ in group and pass the bounds, one distance between rows at a time.

    Rows of a tile are in order of size, so the loop over distances drops a row
    as soon as the one so far away is too large for it.
    """
    if rows.num_rows < 2:
        return
    starts = _run_starts(rows)
    ends = np.repeat(np.append(starts[1:], rows.num_rows), np.diff(np.append(starts, rows.num_rows)))
    ids, n, group, side = (_column(rows, c) for c in ("id", "n", "grp", "of"))
    one_block = _column(rows, "block") == _column(rows, "other")
    words, at, wide = _words(rows["bitmap"].combine_chunks())
    by_width = {width: _folded_to(int(width), words, at, wide) for width in np.unique(wide)}
    here = np.arange(rows.num_rows)
    distance = 0
    while True:
        distance += 1
        here = here[here + distance < ends[here]]
        if not here.size:
            return
        there = here + distance
        fits = n[here] * 100 >= n[there] * percent
        here, there = here[fits], there[fits]
        wanted = (group[here] != group[there]) & (one_block[here] | (side[here] != side[there]))
        i, j = here[wanted], there[wanted]
        if i.size:
            differ = np.zeros(i.size, np.int64)
            common = np.minimum(wide[i], wide[j])
            for width, (bitmap, place) in by_width.items():
                alike = np.flatnonzero(common == width)
                step = max(1, WORDS_AT_ONCE // int(width))
                for start in range(0, alike.size, step):
                    some = alike[start:start + step]
                    differ[some] = np.bitwise_count(bitmap[place[i[some]]] ^ bitmap[place[j[some]]]).sum(axis=1, dtype=np.int64)
            keep = _room(differ, n[i].astype(np.int64), n[j].astype(np.int64), percent)
            a, b = ids[i[keep]], ids[j[keep]]
            if a.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _folded_to(width: int, words: np.ndarray, at: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of ``width`` words or more, folded to that width, as rows of a matrix; and the row of each."""
    place = np.cumsum(wide >= width) - 1
    matrix = np.empty((place[-1] + 1, width), np.uint64)
    for own in np.unique(wide[wide >= width]):
        alike = np.flatnonzero(wide == own)
        step = max(1, WORDS_AT_ONCE // int(own))
        for start in range(0, alike.size, step):
            some = alike[start:start + step]
            matrix[place[some]] = folded(words[at[some] + np.arange(own)[:, None]], width).T
    return matrix, place


def sorted_array(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy()


def verified(pairs: DataFrame, sets: DataFrame, percent: int, read: Callable = sorted_array) -> DataFrame:
    """Pairs whose sorted arrays overlap enough, counted exactly.

    ``sets`` has id and members; ``read`` makes the sorted array of a members
    value, which may also be something shorter that the array follows from.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["m_a"], batch["m_b"])):
                x, y = read(x), read(y)
                common = np.intersect1d(x, y, assume_unique=True).size
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("m_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("m_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m_a", "m_b").mapInArrow(check, "a long, b long")


def pair_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
