"""Packing by power-of-two decomposition: documents cut into pieces of binary lengths, equal lengths in one bucket."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from filmfold.llm.bpe import byte_letters
from filmfold.llm.common import CLEANUP, texts
from filmfold.session import scratch_path

#: The public split of byte-level BPE into pieces, in the form that the encoder takes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest sequence, and the id appended to each document.
SIZE, END = 1024, 0
#: Ids sent on at once.
OUT = 1 << 20


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """Byte-level BPE from the JSON file of a public tokenizer whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"the ids of {path} do not follow its merges")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def lengths(n: int, size: int = SIZE) -> list[int]:
    """Pieces of a document of n ids, in its order: as many of ``size`` as fit, then the powers of two of the rest, falling."""
    whole, rest = divmod(n, size)
    return [size] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _rows(docs: list, found: list[np.ndarray], part: int, nth: dict[int, int], size: int) -> pa.RecordBatch:
    cuts = [lengths(len(ids), size) for ids in found]
    of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    length = np.fromiter((n for c in cuts for n in c), np.int64, len(of))
    ends = np.cumsum(length)
    total = np.array([len(ids) for ids in found], np.int64)
    before = np.cumsum(total) - total
    place = np.empty(len(length), np.int64)  # among the pieces of this length that the task has made
    for n in np.unique(length):
        here = length == n
        place[here] = nth.get(int(n), 0) + np.arange(here.sum())
        nth[int(n)] = nth.get(int(n), 0) + int(here.sum())
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(docs, pa.int64()).take(pa.array(of)), pa.array(ends - length - before[of]), pa.array(length),
        pa.array(total[of]), pa.array(np.full(len(of), part, np.int32)), pa.array(place),
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))),
    ], names=["doc_id", "start", "length", "doc_tokens", "part", "nth", "ids"])


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids: one row a piece.

    A document's ids, the end id included, are cut into pieces of ``size`` (a
    power of two) and then into the powers of two of what is left. A piece is a
    sequence of its own at offset 0, so none holds two documents, none is
    padded, and a batch from one bucket has sequences of one length. Buckets are
    folders named by the length, and sequences are numbered from 0 without gaps
    in the order of falling length.

    Texts and ids are not shuffled: each task cuts and writes what it reads, and
    numbers its pieces of each length; running totals over tasks, one row for
    each task and length, make these the numbers of the whole table. A hot
    source or repeated document is a row like any other.

    A null or empty text gives one piece, the end id alone. Null doc_ids and
    repeated rows are kept, each row with pieces of its own. A piece's rows hold
    nothing of other columns. No rows give no pieces.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, nth = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            names, found, held = [], [], 0
            for row, text in enumerate(texts(batch["text"])):
                ids = bpe.encode(text or "", allowed_special="all")
                ids.append(END)
                names.append(batch["doc_id"][row].as_py())
                found.append(np.array(ids, np.int32))
                held += len(ids)
                if held >= OUT or row == batch.num_rows - 1:
                    yield _rows(names, found, part, nth, size)
                    names, found, held = [], [], 0

    columns = "doc_id long, start long, length long, doc_tokens long, part int, nth long, ids array<int>"
    pieces = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, columns)
    path = scratch_path(spark, "packed")
    pieces.write.option("compression", "zstd").partitionBy("length").parquet(path)
    pieces = spark.read.schema(pieces.schema).parquet(path)
    return pieces.join(_bases(pieces), ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids")


def _bases(pieces: DataFrame) -> DataFrame:
    """length, part, base: the sequences of greater length and of earlier tasks. A window holds one row a task, or one a length."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    path, cleanup = scratch_path(spark, "packed-counts"), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        counts.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleanup)
    counts = spark.read.schema("length long, part int, n long").parquet(path)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("all")).select(
        "length", F.coalesce(F.sum("all").over(longer), F.lit(0)).alias("first"))
    return counts.withColumn("here", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(buckets, "length").select(
        "length", "part", (F.col("first") + F.col("here")).alias("base"))


def checksums(pieces: DataFrame) -> DataFrame:
    """The rows of :func:`pack` with ids_crc32 (unsigned, of the ids as little-endian 32-bit integers) for ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            ends = lists.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))

    return pieces.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
                                  "offset long, ids_crc32 long")
