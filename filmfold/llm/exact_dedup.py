"""Exact duplicates by polynomial fingerprints that compose, confirmed by comparing the texts."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmfold.llm.common import texts, written

#: Bytes hashed at once, and compared at once.
CHUNK = 1 << 16
#: The two largest primes below 2^31; sums of CHUNK products of a byte and a residue stay below 2^64.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)


def _powers(base: int, prime: int) -> np.ndarray:
    """base^(CHUNK-1) ... base^0 by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out


POWERS = tuple(_powers(b, p) for b, p in zip(BASES, PRIMES))


class Fingerprint(NamedTuple):
    """Length in bytes and the value of the bytes as a polynomial, under two bases."""

    length: int
    values: tuple[int, int]

    @property
    def packed(self) -> int:
        return self.values[0] << 31 | self.values[1]


EMPTY = Fingerprint(0, (0, 0))


def of_chunk(data: bytes) -> Fingerprint:
    """At most CHUNK bytes; chunks can be hashed anywhere, in any order."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(codes)
    values = tuple(int((codes * w[CHUNK - n:]).sum() % np.uint64(p)) for w, p in zip(POWERS, PRIMES))
    return Fingerprint(n, values)


def combine(left: Fingerprint, right: Fingerprint) -> Fingerprint:
    """The fingerprint of two texts in a row: the left value is shifted by the right length. Associative."""
    values = tuple((x * pow(b, right.length, p) + y) % p
                   for x, y, b, p in zip(left.values, right.values, BASES, PRIMES))
    return Fingerprint(left.length + right.length, values)


def fingerprint(data: bytes) -> Fingerprint:
    view = memoryview(data)
    return functools.reduce(combine, (of_chunk(view[i:i + CHUNK]) for i in range(0, len(data), CHUNK)), EMPTY)


def same(left: bytes, right: bytes) -> bool:
    """Chunk by chunk, up to the first difference."""
    if len(left) != len(right):
        return False
    a, b = memoryview(left), memoryview(right)
    return all(a[i:i + CHUNK] == b[i:i + CHUNK] for i in range(0, len(left), CHUNK))


def _marks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, digests = [], [], []
            for text in texts(batch["text"]):
                data = (text or "").encode()
                found = fingerprint(data)
                prints.append(found.packed)
                sizes.append(found.length)
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests)],
                names=["doc_id", "print", "n_bytes", "text_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, print long, n_bytes long, text_sha256 string")


def _one_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare copies where they lie and send one of each text on: a text held by a third of all rows
    becomes one row a batch."""
    for batch in batches:
        seen: dict[tuple[int, int], list[bytes]] = {}
        for text in texts(batch["text"]):
            data = (text or "").encode()
            found = fingerprint(data)
            known = seen.setdefault((found.packed, found.length), [])
            if not any(same(data, other) for other in known):
                known.append(data)
        flat = [(key, data) for key, known in seen.items() for data in known]
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k, _ in flat], pa.int64()), pa.array([k[1] for k, _ in flat], pa.int64()),
            pa.array([hashlib.sha256(d).hexdigest() for _, d in flat], pa.string()),
            pa.array([d for _, d in flat], pa.binary()),
        ], names=["print", "n_bytes", "text_sha256", "data"])


def _number_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (print, n_bytes, text_sha256): number the different texts behind a fingerprint.

    Each row is compared with the one text before it, so a run of any length
    needs the memory of two texts.
    """
    key, last, number = None, b"", 0
    for batch in batches:
        numbers = []
        for i in range(batch.num_rows):
            now, data = (batch["print"][i].as_py(), batch["n_bytes"][i].as_py()), batch["data"][i].as_py()
            number = 0 if now != key else number + (not same(data, last))
            key, last = now, data
            numbers.append(number)
        yield batch.drop_columns(["data"]).append_column("number", pa.array(numbers, pa.int32()))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of equal texts the row with the largest doc_id stays.

    One pass writes a fingerprint per document. Only texts whose fingerprint
    and length occur again are read a second time, compared within each task
    first and then in sorted runs, so neither a large group nor an accidental
    collision needs a group in memory. The SHA-256 only orders a run.

    A null text counts as empty. Rows alike in doc_id and text cannot be told
    apart: each counts in group_size and has the same kept. A null doc_id is
    smaller than any other. Other columns are ignored; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = written(_marks(docs), "marks")
    again = marks.groupBy("print", "n_bytes").count().filter("count > 1")
    wanted = written(marks.join(again, ["print", "n_bytes"], "left_semi").select("doc_id").distinct(), "again")
    compared = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi").mapInArrow(
        _one_per_batch, "print long, n_bytes long, text_sha256 string, data binary")
    numbers = written(
        compared.repartition("print", "n_bytes").sortWithinPartitions("print", "n_bytes", "text_sha256")
        .mapInArrow(_number_texts, "print long, n_bytes long, text_sha256 string, number int"), "numbers").distinct()
    parts = ["print", "n_bytes", "text_sha256"]
    sized = marks.groupBy(parts).agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    group = ["print", "n_bytes", F.coalesce("number", F.lit(0)).alias("number")]
    named = sized.join(numbers, parts, "left").select(*parts, group[2], "last", "rows")
    whole = named.groupBy("print", "n_bytes", "number").agg(
        F.max("last").alias("keep_id"), F.sum("rows").alias("group_size"))
    classes = written(named.join(whole, ["print", "n_bytes", "number"]).select(*parts, "keep_id", "group_size"),
                      "classes")
    return marks.join(classes, parts).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they are."""
    gone = duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.doc_id), "left_anti")
