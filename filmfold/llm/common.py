"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmfold.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from its files.

    The files survive a lost executor, cut the lineage and tell the planner the
    true size. Shuffle files of the finished write are dropped at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; bytes.split and bytes.lower know ASCII only."""
    return text.encode().lower().split() if text else []


def texts(column: pa.Array) -> Iterator[str | None]:
    """One value at a time, so a batch of long texts is not held twice."""
    for value in column:
        yield value.as_py()


def hashes(parts: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, count)


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)


def parity_bitmap(values: np.ndarray, bits: int) -> bytes:
    """One bit per hash slot: is the number of values that fall in it odd?

    Two sets whose bitmaps differ in h bits differ in at least h elements, so
    h bounds their overlap from above without reading either set.
    """
    slots = np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((slots & 1).astype(bool)).tobytes()


def wide_bits(count: int, least: int) -> int:
    """A power of two of at least one bit per element."""
    return max(least, 1 << max(0, count - 1).bit_length())


def folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """The parity bitmap of fewer slots (a power of two of 64-bit words), from that of more: halves laid together."""
    while len(bitmap) > width:
        bitmap = bitmap[:len(bitmap) // 2] ^ bitmap[len(bitmap) // 2:]
    return bitmap


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
