"""Similarity join of documents by the Jaccard index of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from filmfold.llm import buckets
from filmfold.llm.common import hashes, long_lists, mixed, parity_bitmap, signed, texts, wide_bits, \
    words, written
from filmfold.llm.components import components

SHINGLE = 5
PERCENT = 75
BITS = 1024
#: How many documents give the list of common shingles, how often one must occur in them, and how many are listed.
ORDER_DOCS, ORDER_LEAST, ORDER_MOST = 8000, 4, 200_000

#: An odd factor for each place in a shingle, so that order counts.
_WEIGHTS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; fewer words are one run, none is empty."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    ids = hashes(tokens, len(tokens))
    span = min(size, len(ids))
    last = len(ids) - span + 1
    run = np.full(last, span, np.uint64)
    for k in range(span):
        run += ids[k:k + last] * _WEIGHTS[k]
    return np.unique(mixed(run))


def prefix(values: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The elements of which two sets that reach the similarity must share one.

    Sets are ordered with the listed common shingles last, else by hash. A
    partner holds at least percent of the set, so it cannot miss all of the
    first n - ceil(n * percent / 100) + 1. Any order gives the same links; this
    one keeps passages that many documents hold out of the buckets.
    """
    n = len(values)
    keep = n - -(-n * percent // 100) + 1
    if common.size and n:
        at = np.minimum(np.searchsorted(common, values), common.size - 1)
        is_common = common[at] == values
        values = np.concatenate([values[~is_common], values[is_common]])
    return values[:keep]


def common_shingles(docs: DataFrame) -> np.ndarray:
    """A list of frequent shingles, from a bounded number of documents; it decides an order, never a result."""
    total = docs.count()
    every = max(1, total // ORDER_DOCS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(shingles(text)) for text in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([long_lists(found).flatten()], names=["key"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(every)) == 0).select("text")
    rows = some.mapInArrow(hashed, "key long").groupBy("key").count().filter(F.col("count") >= ORDER_LEAST) \
        .orderBy(F.desc("count"), "key").limit(ORDER_MOST).select("key").toArrow()
    return np.sort(rows["key"].to_numpy().view(np.uint64))


def _profiles(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, its prefix and its bitmap, of BITS or about n bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, firsts, wide = [], [], [], []
            for text in texts(batch["text"]):
                values = shingles(text)
                sizes.append(len(values))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                firsts.append(signed(prefix(values, common)) if len(values) else np.empty(0, np.int64))
                wide.append(parity_bitmap(values, wide_bits(len(values), BITS)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), long_lists(firsts),
                 pa.array(wide, pa.binary())],
                names=["doc_id", "n", "digest", "prefix", "wide"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, digest binary, prefix array<long>, wide binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole sorted shingle array of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [signed(np.sort(signed(shingles(t)))) for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], long_lists(arrays)], names=["id", "members"])

    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id")
    return chosen.mapInArrow(run, "id long, members array<long>")


def _links(docs: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    near = written(buckets.bitmap_filter(pairs, items, PERCENT), "near-pairs")
    sets = written(_sets(docs, buckets.pair_ids(near)), "near-sets")
    return written(buckets.verified(near, sets, PERCENT), "near-links")


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: who is linked, directly or through others, by a Jaccard index of 0.75.

    Documents with equal shingle sets are one item from the start. Items are
    bucketed by the shingles of their prefix, so no link is missed; hubs and then
    neighbours link large groups, and tiles of bitmaps settle the rest of a
    bucket, see ``buckets``. Only pairs that pass both bounds have their sets compared.

    Null and empty texts have no shingles, link with nothing and are their own
    component. Rows that share a doc_id are one node and link what any of them
    links. A null doc_id stays null and unlinked. Other columns are ignored. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = common_shingles(docs)
    profiles = written(_profiles(docs, common), "profiles")
    full = profiles.filter("n > 0")
    firsts = written(full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")),
                     "equal-sets")
    one = full.join(firsts.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"]) \
        .withColumnRenamed("doc_id", "id")
    items = written(one.select("id", "n", "wide"), "items")
    keys = one.select(F.explode("prefix").alias("key"), "id", F.col("n").cast("int").alias("n"))
    members = written(buckets.shared(keys), "members")
    links = _links(docs, buckets.hub_pairs(members, PERCENT), items)
    groups = written(components(links), "groups")
    # Groups only grow, so a bucket that is settled once needs no further look, nor does one with the items of another.
    unsettled = written(buckets.unsettled(members, groups).drop("grp"), "unsettled")
    unsettled = written(buckets.distinct_buckets(unsettled), "buckets")
    near = written(buckets.neighbour_pairs(unsettled, groups, PERCENT, few=True), "neighbour-pairs")
    links = links.union(_links(docs, near, items))
    groups = written(components(links), "groups")
    bitmaps = items.select("id", F.col("wide").alias("bitmap"))
    cross = written(buckets.cross_pairs(unsettled, groups, bitmaps, PERCENT), "cross-pairs")
    more = _links(docs, cross, items)
    groups = written(components(links.union(more)), "groups")

    # A doc_id with several texts can stand for several sets; each set knows its smallest doc_id.
    sets = full.select("digest", "doc_id").join(firsts.select("digest", "id"), "digest")
    named = sets.join(groups, F.col("id") == F.col("node"), "left") \
        .groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    return profiles.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """Keep the document with the smallest doc_id of each component, all columns as they are."""
    found = written(near_documents(docs), "near-documents")
    drop = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
