"""Alternating least squares for many ratings: explicit, non-negative, weighted by counts, as MLlib fits it.

MLlib sends every vector to nearly every block in every iteration, so what it
shuffles grows with vectors times blocks, and few blocks leave cores idle. Here
the ratings are packed once into blocks of arrays, by user and by film. A half
iteration writes the vectors of one side as packed rows; the next has one task
a block, which reads these and its own ratings from files, so an iteration
shuffles nothing and writes each vector once, with any number of blocks. A task
holds the vectors of the other side as one array (four bytes a number) and the
ratings of its block (eight bytes each). First vectors are drawn from ids and
sums run in the order of ids, so factors do not depend on blocks or cores.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmfold.session import delete, materialise, scratch_path

BLOCK_ROWS = 8_000_000  # ratings of one block, held by one task
CHUNK = 1 << 18  # numbers or vectors packed into one row
PART = 1 << 16  # ratings of one user or film summed at once
CELLS = 1 << 20  # numbers of the vectors summed at once
POOL = 4096  # systems solved together

IDS, RATED, VECTORS = 0, 1, 2  # ids and counts; films (or users) and stars; vectors and ids
PACKED = "block int, kind int, seq int, a binary, b binary"
ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("seq", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

register_pickle_by_value(sys.modules[__name__])  # tasks get the functions below with their code


class Side(NamedTuple):
    """One side's ratings: its ids, a table of ids and ratings for each block, the place of each block's first id, the folders."""

    spark: SparkSession
    ids: DataFrame
    blocks: list[DataFrame]
    first: list[int]
    paths: list[str]


def block_count(cores: int, rows: int) -> int:
    """As many blocks as the ratings need, in whole rounds of all cores."""
    return cores * max(1, -(-rows // (BLOCK_ROWS * cores)))


def checked(ratings: DataFrame) -> DataFrame:
    """Ids as int and stars as float; anything else than MLlib takes is an error."""
    def whole(name: str) -> Column:
        value = F.col(name)
        bad = value.isNull() | (value.cast("double") != F.floor(value.cast("double"))) | ~value.cast("double").between(-2**31, 2**31 - 1)
        return F.when(bad, F.raise_error(F.lit(f"{name}: ids must be whole numbers in the range of int"))).otherwise(value.cast("int"))

    stars = F.col("rating").cast("float")
    bad = stars.isNull() | F.isnan(stars)
    return ratings.select(
        whole("userId").alias("userId"), whole("movieId").alias("movieId"),
        F.when(bad, F.raise_error(F.lit("rating: null or not a number"))).otherwise(stars).alias("rating"),
    )


def _rows(block: int, kind: int, a: np.ndarray, b: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for seq, at in enumerate(range(0, len(a), CHUNK)):
        blobs = [None if x is None else x[at:at + CHUNK].tobytes() for x in (a, b)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip([block, kind, seq, *blobs], ARROW.types)], schema=ARROW)


def _numbers(batch: pa.RecordBatch, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype) for v in batch.column(name)]


def _joined(found: dict, dtype) -> np.ndarray:
    """Arrays by their place, as one array."""
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.empty(0, dtype)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratings (block, dst, src, rating) as packed rows, sorted by both ids."""
    found = list(batches)
    if not found:
        return
    block, dst, src, rating = (pa.chunked_array(c).to_numpy() for c in zip(*(b.columns for b in found)))
    del found
    for number in np.unique(block):
        mine = slice(None) if block[0] == number and (block == number).all() else block == number
        key = (dst[mine].astype(np.int64) << 32) + (src[mine].astype(np.int64) + (1 << 31))
        order = np.argsort(key, kind="stable")
        ids, counts = np.unique(key[order] >> 32, return_counts=True)
        yield from _rows(int(number), IDS, ids.astype(np.int32), counts.astype(np.int32))
        yield from _rows(int(number), RATED, src[mine][order], rating[mine][order])


def _placed():
    """Arrow function that puts the other side's places where its ids stand."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rated, block = {}, {}, None
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "seq")))
            for (b, kind, seq), a, stars in zip(numbers, batch.column("a"), batch.column("b")):
                if kind == IDS:
                    ids[b, seq] = np.frombuffer(a.as_buffer(), np.int32).copy()
                else:
                    block, rated[seq] = b, (np.frombuffer(a.as_buffer(), np.int32).copy(), np.frombuffer(stars.as_buffer(), np.float32).copy())
        if block is None:
            return
        known = _joined(ids, np.int32)
        order = np.argsort(known, kind="stable").astype(np.int32)
        known = known[order]
        src = _joined({k: v[0] for k, v in rated.items()}, np.int32)
        stars = _joined({k: v[1] for k, v in rated.items()}, np.float32)
        yield from _rows(block, RATED, order[np.searchsorted(known, src)], stars)

    return place


def _separate(spark: SparkSession) -> SparkSession:
    """A session in which a union keeps the tasks of its parts, though each is one partition."""
    session = spark.newSession()
    session.conf.set("spark.sql.unionOutputPartitioning", "false")
    return session


def _one_task_each(parts: list[DataFrame], shared: DataFrame, run, schema: str) -> DataFrame:
    """Each part goes through ``run`` with the whole of ``shared``, in a task of its own that reads both from files."""
    return reduce(DataFrame.union, [part.union(shared).coalesce(1).mapInArrow(run, schema) for part in parts])


def _by_block(table: DataFrame, blocks: int) -> list[DataFrame]:
    return [table.filter(F.col("block") == number).select(*ARROW.names) for number in range(blocks)]


def prepare(ratings: DataFrame, blocks: int | None = None) -> tuple[Side, Side]:
    """Pack ratings (userId, movieId, rating), written once for both, by user and by film. :func:`release` drops the files."""
    spark = ratings.sparkSession
    apart = _separate(spark)
    table_path = scratch_path(spark, "als-ratings")
    checked(ratings).write.parquet(table_path)
    rows = spark.read.schema("userId int, movieId int, rating float").parquet(table_path)
    blocks = blocks or block_count(spark.sparkContext.defaultParallelism, rows.count())

    def packed(dst: str, src: str) -> tuple[str, DataFrame]:
        path = scratch_path(spark, f"als-{dst}")
        # the number of a block is that of the partition its rows are dealt to
        dealt = rows.select(F.pmod(F.hash(dst), F.lit(blocks)).alias("block"), dst, src, "rating").repartition(blocks, dst)
        dealt.mapInArrow(_pack, PACKED).write.partitionBy("kind", "block").option("compression", "none").parquet(path)
        return path, apart.read.schema(PACKED).parquet(path)

    def places(ids: DataFrame) -> list[int]:
        counts = {r.block: r.n for r in ids.groupBy("block").agg((F.sum(F.length("a")) / 4).cast("bigint").alias("n")).collect()}
        return np.cumsum([0, *(counts.get(b, 0) for b in range(blocks))]).tolist()

    (user_path, users), (item_path, items) = packed("userId", "movieId"), packed("movieId", "userId")
    ids = [table.filter(F.col("kind") == IDS).select(*ARROW.names) for table in (users, items)]
    first = [places(side) for side in ids]
    delete(spark, table_path)
    sides = []
    for table, mine, other in ((users, 0, 1), (items, 1, 0)):
        path = scratch_path(spark, "als-rated")
        rated = _by_block(table.filter(F.col("kind") == RATED), blocks)
        _one_task_each(rated, ids[other], _placed(), PACKED).write.partitionBy("block").option("compression", "none").parquet(path)
        placed = _by_block(apart.read.schema(PACKED).parquet(path), blocks)
        own = _by_block(ids[mine], blocks)
        sides.append(Side(spark, ids[mine], [x.union(y) for x, y in zip(own, placed)], first[mine], [(user_path, item_path)[mine], path]))
    for path in (user_path, item_path):
        delete(spark, f"{path}/kind={RATED}")
    return sides[0], sides[1]


def release(*sides: Side) -> None:
    for side in sides:
        for path in side.paths:
            delete(side.spark, path)


def first_vectors(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Unit vectors without negative entries, drawn from id and seed alone: absolute normal numbers, as MLlib draws them."""
    def mixed(x: np.ndarray) -> np.ndarray:  # splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        base = mixed(ids.astype(np.int64).astype(np.uint64) * step + mixed(np.full(1, seed, np.int64).astype(np.uint64) + step))
        draws = mixed(base[:, None] + np.arange(1, 2 * rank + 1, dtype=np.uint64) * step)
    uniform = ((draws >> np.uint64(11)).astype(float) + 0.5) / 2**53
    normal = np.abs(np.sqrt(-2 * np.log(uniform[:, :rank])) * np.cos(2 * np.pi * uniform[:, rank:]))
    return (normal / np.sqrt((normal * normal).sum(axis=1))[:, None]).astype(np.float32)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of symmetric positive definite systems; ``a`` (k, k, m) and ``b`` (k, m) are overwritten."""
    k = len(b)
    for j in range(k - 1):
        f = a[j + 1:, j] / a[j, j]
        a[j + 1:, j + 1:] -= f[:, None] * a[j, j + 1:]
        b[j + 1:] -= f * b[j]
    for j in range(k - 1, -1, -1):
        if j < k - 1:
            b[j] -= (a[j, j + 1:] * b[j + 1:]).sum(axis=0)
        b[j] /= a[j, j]
    return b


def non_negative(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """argmin x'Gx/2 - r'x with x >= 0 for each row of ``gram`` (m, k, k) and ``rhs`` (m, k), by block principal pivoting.

    Entries of the wrong sign change sides together; a row in which that makes
    no progress three times changes one entry at a time, which always ends.
    """
    m, k = rhs.shape
    out, todo = np.zeros((m, k)), np.arange(m)
    free, least, tries = np.ones((m, k), bool), np.full(m, k + 1), np.full(m, 3)
    scale = 1e-12 * np.abs(rhs).max(axis=1, initial=0)
    tile = max(32, 60_000 // (k * k))
    for _ in range(10 * k + 100):
        again = []
        for at in range(0, len(todo), tile):
            row = todo[at:at + tile]
            a, b, on = np.ascontiguousarray(gram[row].transpose(1, 2, 0)), np.ascontiguousarray(rhs[row].T), free[row].T
            whole = on.all()
            left = a.copy() if whole else a * (on[:, None] & on)
            if not whole:
                left[np.arange(k), np.arange(k)] += ~on
            x = _solved(left, b * on)
            if whole:
                wrong = x < 0
            else:
                x *= on
                wrong = np.where(on, x < 0, (a * x).sum(axis=1) - b < -scale[row])
            count = wrong.sum(axis=0)
            out[row] = np.maximum(x, 0).T
            if not count.any():
                continue
            bad = np.flatnonzero(count)
            row, wrong, count = row[bad], wrong[:, bad].T, count[bad]
            better = count < least[row]
            least[row[better]], tries[row[better]] = count[better], 3
            tries[row[~better]] -= 1
            single = np.flatnonzero(tries[row] < 0)
            if single.size:  # only the last entry of the wrong sign
                last = k - 1 - np.argmax(wrong[single, ::-1], axis=1)
                wrong[single] = False
                wrong[single, last] = True
            free[row] ^= wrong
            again.append(row)
        if not again:
            break
        todo = np.concatenate(again)
    return out


def solve_rows(vectors: np.ndarray, counts: np.ndarray, src: np.ndarray, stars: np.ndarray, reg: float) -> np.ndarray:
    """Vectors of the rows that have ``counts`` ratings each, one after another in ``src`` (rows of ``vectors``) and ``stars``.

    Rows with equally many ratings are summed together; the ridge term is
    ``reg`` times that number.
    """
    k, out = vectors.shape[1], np.empty((len(counts), vectors.shape[1]), np.float32)
    start = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    ends = np.flatnonzero(np.diff(counts[order], append=-1)) + 1
    gram, rhs, rows, full = np.empty((POOL, k, k)), np.empty((POOL, k)), np.empty(POOL, np.int64), 0
    diagonal = np.arange(k)

    def flush() -> None:
        out[rows[:full]] = non_negative(gram[:full], rhs[:full])

    for lo, hi in zip([0, *ends[:-1]], ends):
        count = int(counts[order[lo]])
        width = min(count, PART)
        while lo < hi:
            some = order[lo:min(hi, lo + max(1, CELLS // (width * (k + 1))), lo + POOL - full)]
            total = 0
            for part in range(0, count, PART):
                at = start[some][:, None] + np.arange(part, min(count, part + PART))
                x = np.empty((*at.shape, k + 1))
                x[..., :k], x[..., k] = np.take(vectors, src[at], axis=0, mode="clip"), stars[at]
                total = total + np.matmul(x.transpose(0, 2, 1), x)
            to = slice(full, full + len(some))
            gram[to], rhs[to], rows[to] = total[:, :k, :k], total[:, :k, k], some
            # a ridge of nothing leaves the least one that keeps a system solvable
            trace = gram[to][:, diagonal, diagonal].sum(axis=1)
            gram[to, diagonal, diagonal] += np.maximum(reg * count, 1e-12 * trace + 1e-300)[:, None]
            full, lo = full + len(some), lo + len(some)
            if full == POOL:
                flush()
                full = 0
    flush()
    return out


def _half(rank: int, reg: float, first: list[int]):
    """Arrow function of one block: the other side's vectors, its own ids and ratings in, its vectors out."""
    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids, rated, block = np.empty((first[-1], rank), np.float32), {}, {}, None
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "seq")))
            for (b, kind, seq), a, other in zip(numbers, batch.column("a"), batch.column("b")):
                if kind == VECTORS:
                    some = np.frombuffer(a.as_buffer(), np.float32).reshape(-1, rank)
                    at = first[b] + seq * CHUNK
                    vectors[at:at + len(some)] = some
                elif kind == IDS:
                    block, ids[seq] = b, (np.frombuffer(a.as_buffer(), np.int32).copy(), np.frombuffer(other.as_buffer(), np.int32).copy())
                else:
                    rated[seq] = np.frombuffer(a.as_buffer(), np.int32).copy(), np.frombuffer(other.as_buffer(), np.float32).copy()
        if block is None:
            return
        keys, counts = (_joined({k: v[i] for k, v in ids.items()}, np.int32) for i in (0, 1))
        src = _joined({k: v[0] for k, v in rated.items()}, np.int32)
        stars = _joined({k: v[1] for k, v in rated.items()}, np.float32)
        rated.clear()
        yield from _rows(block, VECTORS, solve_rows(vectors, counts.astype(np.int64), src, stars, reg), keys)

    return half


def _begin(rank: int, seed: int):
    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, seq, a in zip(batch.column("block").to_pylist(), batch.column("seq").to_pylist(), _numbers(batch, "a", np.int32)):
                row = [block, VECTORS, seq, first_vectors(a, rank, seed).tobytes(), a.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW.types)], schema=ARROW)

    return begin


def _unpacked(rank: int):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vectors, ids in zip(_numbers(batch, "a", np.float32), _numbers(batch, "b", np.int32)):
                for at in range(0, len(ids), 10_000):
                    some = ids[at:at + 10_000]
                    flat = pa.array(vectors[at * rank:(at + len(some)) * rank], pa.float32())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * rank, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], names=["id", "features"])

    return unpack


def fit(user: Side, item: Side, rank: int, reg: float, max_iter: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """User and film vectors (id, features) as written tables. Each half iteration's vectors replace those it came from."""
    spark = user.spark

    def written(vectors: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, "als-vectors")
        vectors.write.option("compression", "none").parquet(path)
        return path, vectors.sparkSession.read.schema(PACKED).parquet(path)

    def begin(side: Side) -> tuple[str, DataFrame]:
        return written(side.ids.mapInArrow(_begin(rank, seed), PACKED))

    def half(side: Side, other: Side, vectors: DataFrame) -> tuple[str, DataFrame]:
        sent = vectors.select("block", "kind", "seq", "a", F.lit(None).cast("binary").alias("b"))
        return written(_one_task_each(side.blocks, sent, _half(rank, reg, other.first), PACKED))

    (user_path, users), (item_path, items) = begin(user), begin(item)
    for _ in range(max_iter):
        for old, side in ((item_path, "item"), (user_path, "user")):
            if side == "item":
                item_path, items = half(item, user, users)
            else:
                user_path, users = half(user, item, items)
            delete(spark, old)
    out = []
    for path in (user_path, item_path):
        vectors = spark.read.schema(PACKED).parquet(path)
        out.append(materialise(vectors.mapInArrow(_unpacked(rank), "id int, features array<float>"), "als-factors"))
        delete(spark, path)
    return out[0], out[1]
