"""Scoring users against films with latent vectors.

Scoring every user against every film is the product of two tables, so the
pairs are never made into rows. Users are cut into chunks and films into
blocks of bounded size, Spark shuffles each (chunk, block) together, one
matrix product scores it and only the best k films per user leave the task.
A window keeps the best k over all blocks. Both cuts come from row counts, so
tasks grow with the tables and no side has to fit into one task or the driver.

Of many films without filters the longest vectors are scored first. A user
whose k-th score among these is more than the user's length times that of any
vector left is through, and only the others meet the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold import fixed
from filmfold.functions import numbers as N
from filmfold.session import materialise

CHUNK_ROWS = 250_000  # users per chunk
BLOCK_ROWS = 1 << 20  # films per block
SLICE = 4096  # films of a block scored side by side
CELLS = 500_000   # scores held at once inside a task
HEAD_ROWS = 1 << 18  # films with the longest vectors, scored before the rest

FILTER_COLUMNS = ["wanted", "year_from", "year_to", "cnt_min", "cnt_max", "affinity"]
FILM_COLUMNS = ["mask", "year", "cnt"]
OUTPUT = "qid bigint, id bigint, cnt int, score double, rank_score double"


def score_pairs(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Add ``score`` to given (userId, movieId) rows; pairs without both vectors drop out.

    Plain equi-joins with one vector row per id: a hot user or film is a
    skewed join partition on the pairs side, which adaptive execution splits.
    """
    users = user_factors.select(F.col("id").alias("userId"), F.col("features").alias("u"))
    items = item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("v"))
    scored = pairs.join(users, "userId").join(items, "movieId")
    return scored.withColumn("score", N.dot(F.col("u"), F.col("v"))).drop("u", "v")


def pieces(df: DataFrame, rows: int, at_least: int = 1) -> int:
    """Number of pieces of at most about ``rows`` rows, from a count of the table.
    Small inputs are still spread over ``at_least`` pieces while these keep over 1024 rows."""
    n = df.count()
    return max(1, -(-n // rows), min(at_least, -(-n // 1024)))


def _block_scorer(k: int, filtered: bool, bonus: float):
    """Arrow function scoring one chunk of queries against one block of films."""
    bits = np.arange(len(fixed.GENRES))
    cells, ranges = CELLS, FILTER_COLUMNS[:-1]
    names = ["qid", "id", "cnt", "score", "rank_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]

    def matrix(table, name):
        flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.asarray(flat, dtype=float).reshape(table.num_rows, -1)

    def numbers(table, name):
        return table.column(name).to_numpy()

    def film_arrays(films):
        """Film columns, longest vectors first; ``tie`` is the place among equals: more ratings first, then the lower id."""
        ids = numbers(films, "id")
        cnt = numbers(films, "cnt") if filtered else np.zeros(len(ids), dtype=np.int32)
        vectors = matrix(films, "vector")
        tie = np.empty(len(ids), dtype=np.int64)
        tie[np.lexsort((ids, -cnt))] = np.arange(len(ids))
        length = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        out = {"id": ids[order], "cnt": cnt[order], "vector": vectors[order], "tie": tie[order], "length": length[order]}
        if filtered:
            out |= {"mask": numbers(films, "mask")[order], "year": numbers(films, "year")[order]}
        return out

    def groups(queries, f):
        """(query rows, films they may get): queries with equal filters share one cut."""
        if not filtered:
            yield np.arange(queries.num_rows), f
            return
        keys = np.stack([numbers(queries, c) for c in ranges], axis=1)
        distinct, group_of = np.unique(keys, axis=0, return_inverse=True)
        by_group = np.argsort(group_of.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(group_of.ravel(), minlength=len(distinct)))
        for (wanted, y0, y1, c0, c1), start, end in zip(distinct, [0, *ends[:-1]], ends):
            fits = (
                ((f["mask"] & wanted) != 0)
                & (f["year"] >= y0) & (f["year"] <= y1) & (f["cnt"] >= c0) & (f["cnt"] <= c1)
            )
            if fits.any():
                yield by_group[start:end], {name: column[fits] for name, column in f.items()}

    def genre_fits(affinity, masks):
        """Fit of every query row to every distinct mask."""
        member = (masks[:, None] >> bits) & 1 == 1
        taste = affinity / np.maximum(1.0, affinity.max(axis=1))[:, None]
        best = np.full((len(taste), len(masks)), -np.inf)
        for bit in bits:
            best = np.where(member[:, bit], np.maximum(best, taste[:, bit, None]), best)
        return (best + taste @ member.T / member.sum(axis=1)) / 2  # a mask that passed is not empty

    def best_of(u, g, v32, largest, fit, mask_no, pairs, floor):
        """(row, col, value, ranking) of the k best films of every row of ``u``, but for the excluded ``pairs`` (row, col).

        Films come in slices, longest vectors first. Each row's k-th best so far
        is the bar for the next slice, and a row whose product with the longest
        vector left cannot reach its bar is through. ``floor`` is the bar to begin
        with, known from k other films, or minus infinity. Single precision finds
        candidates, with its error bound as slack; exact sums in a fixed order
        decide among them.
        """
        v, n, dims = g["vector"], len(g["id"]), u.shape[1]
        extra = abs(bonus) * np.abs(fit).max(axis=1) if fit is not None else np.zeros(len(u))
        slack = 4 * 1.2e-7 * (dims + 4) * (np.abs(u).sum(axis=1) * largest + extra)
        u32, u_length = u.astype(np.float32), np.sqrt((u * u).sum(axis=1))
        bar = floor.copy()
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        if pairs is not None:
            order = np.argsort(pairs[1], kind="stable")
            out_row, out_col = pairs[0][order], pairs[1][order]
        live = np.arange(len(u))
        for start in range(0, n, SLICE):
            end = min(n, start + SLICE)
            live = live[u_length[live] * (g["length"][start] * (1 + 1e-9)) + extra[live] >= bar[live] - slack[live]]
            if not live.size:
                break
            estimate = u32[live] @ v32[:, start:end]
            if fit is not None:
                estimate += (bonus * fit[live]).astype(np.float32)[:, mask_no[start:end]]
            if pairs is not None:
                here = slice(*np.searchsorted(out_col, [start, end]))
                at = np.minimum(np.searchsorted(live, out_row[here]), live.size - 1)
                met = live[at] == out_row[here]
                estimate[at[met], out_col[here][met] - start] = -np.inf
            bound = bar[live] - slack[live]
            fresh = np.flatnonzero(bound == -np.inf)  # rows without k films yet
            if fresh.size:
                kth = end - start - min(k, end - start)
                bound[fresh] = np.partition(estimate[fresh], kth, axis=1)[:, kth] - slack[live[fresh]]
            close = estimate >= bound[:, None].astype(np.float32)
            if fresh.size:
                close &= estimate > -np.inf
            row, col = np.divmod(np.flatnonzero(close), end - start)
            if not row.size:
                continue
            row, col = live[row], col + start
            value = np.zeros(len(row))
            for d in range(dims):
                value += u[row, d] * v[col, d]
            ranking = value if fit is None else value + bonus * fit[row, mask_no[col]]
            row, col, value, ranking = (np.concatenate(c) for c in zip(kept, (row, col, value, ranking)))
            order = np.lexsort((g["tie"][col], -ranking, row))
            place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            top = order[place < k]
            kept = row[top], col[top], value[top], ranking[top]
            full = order[place == k - 1]
            bar[row[full]] = np.maximum(bar[row[full]], ranking[full])
        return kept

    def score(queries: pa.Table, films: pa.Table) -> pa.Table:
        out = []
        if films.num_rows and queries.num_rows:
            f = film_arrays(films)
            qid, vectors = numbers(queries, "qid"), matrix(queries, "vector")
            affinity = matrix(queries, "affinity") if filtered else None
            floor = numbers(queries, "floor") if "floor" in queries.column_names else np.full(len(qid), -np.inf)
            excluded = queries.column("excluded").combine_chunks()
            n_gone = np.asarray(excluded.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            gone = excluded.flatten().to_numpy(zero_copy_only=False)
            gone_from = np.cumsum(n_gone) - n_gone
            for rows, g in groups(queries, f):
                v32, largest = g["vector"].T.astype(np.float32), np.abs(g["vector"]).max()
                masks = mask_no = sorted_ids = None
                if gone.size:
                    by_id = np.argsort(g["id"])
                    sorted_ids = g["id"][by_id]
                if filtered:
                    masks, mask_no = np.unique(g["mask"], return_inverse=True)
                tile = max(1, cells // min(SLICE, len(g["id"])))
                for start in range(0, len(rows), tile):
                    part = rows[start:start + tile]
                    fit = genre_fits(affinity[part], masks) if filtered else None
                    pairs, lengths = None, n_gone[part]
                    if lengths.any():
                        row = np.repeat(np.arange(len(part)), lengths)
                        within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                        ids = gone[np.repeat(gone_from[part], lengths) + within]
                        at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
                        known = sorted_ids[at] == ids
                        pairs = row[known], by_id[at[known]]
                    row, col, value, ranking = best_of(vectors[part], g, v32, largest, fit, mask_no, pairs, floor[part])
                    out.append((qid[part][row], g["id"][col], g["cnt"][col], value, ranking))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * len(names)
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, columns, types)})

    return score


def slot_keys(n: int) -> list[int]:
    """A key for each of n partitions that Spark's hash deals to it, so that n groups lie in n tasks, not several in one."""
    found, start = {}, 0
    while len(found) < n:
        x = np.arange(start, start + 4 * n + 64, dtype=np.uint32)
        with np.errstate(over="ignore"):
            h = x * np.uint32(0xCC9E2D51)
            h = ((h << np.uint32(15)) | (h >> np.uint32(17))) * np.uint32(0x1B873593) ^ np.uint32(42)
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
        for key, slot in zip(x.tolist(), (h.view(np.int32).astype(np.int64) % n).tolist()):
            found.setdefault(slot, key)
        start += len(x)
    return [found[slot] for slot in range(n)]


def _scored(
    queries: DataFrame, items: DataFrame, k: int, excluded: DataFrame | None, filtered: bool, bonus: float,
    chunk_rows: int, block_rows: int, counted: DataFrame | None,
) -> DataFrame:
    """The best k of every block for each query."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = pieces(items, block_rows)
    chunks = pieces(counted if counted is not None else queries, chunk_rows, 4 * cores)
    tasks = blocks * chunks  # one task a (chunk, block) at any size
    n_blocks, n_chunks = F.lit(blocks), F.lit(chunks)
    keys = F.array(*[F.lit(key) for key in slot_keys(tasks)])

    def block_of(col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.col("n_blocks")).cast("int")

    def dealt(df: DataFrame) -> DataFrame:
        slot = F.element_at(keys, F.col("chunk") * n_blocks + F.col("block") + 1)
        return df.withColumn("slot", slot).drop("chunk", "block").repartition(tasks, "slot")

    left = queries.withColumn("chunk", F.pmod(F.xxhash64("qid"), n_chunks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), n_blocks - 1))
    )
    if excluded is not None:
        per_block = (
            excluded.select("qid", "id").distinct()
            .withColumn("n_blocks", n_blocks)
            .groupBy("qid", block_of("id").alias("block"))
            .agg(F.collect_list("id").alias("excluded"))
        )
        left = left.join(per_block, ["qid", "block"], "left")
    else:
        left = left.withColumn("excluded", F.lit(None).cast("array<bigint>"))
    right = (
        items.withColumn("n_blocks", n_blocks)
        .withColumn("block", block_of("id"))
        .drop("n_blocks")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    )
    # fixed partitions: merging them by size would put few bytes but much scoring into one task
    return (
        dealt(left).groupBy("slot")
        .cogroup(dealt(right).groupBy("slot"))
        .applyInArrow(_block_scorer(k, filtered, bonus), OUTPUT)
    )


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("rank_score"), F.desc("cnt"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _length(vector: str) -> Column:
    return F.sqrt(N.dot(F.col(vector), F.col(vector)))


def _longest_first(queries: DataFrame, items: DataFrame, k: int, n_items: int, head_rows: int, cut: dict) -> DataFrame:
    """Ranked lists from the longest ``head_rows`` vectors or so, and from the rest for queries these do not settle."""
    items = items.withColumn("length", _length("vector"))
    least = items.agg(F.percentile_approx("length", 1 - head_rows / n_items, 10_000)).first()[0]
    in_head = F.coalesce(F.col("length") >= F.lit(least), F.lit(False))
    head, rest = (items.filter(c).drop("length") for c in (in_head, ~in_head))
    settled = materialise(_ranked(_scored(queries, head, k, None, False, 0.0, **cut), k), "longest-picks")
    floors = settled.filter(F.col("rank") == k).select("qid", F.col("rank_score").alias("floor"))
    reach = _length("vector") * F.lit(least) * (1 + 1e-9)
    left = materialise(
        queries.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        .filter(F.coalesce(reach >= F.col("floor"), F.lit(True))), "unsettled")
    if left.isEmpty():
        return settled
    more = _scored(left, rest, k, None, False, 0.0, **(cut | {"counted": None}))
    return _ranked(settled.drop("rank").unionByName(more), k)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int = fixed.TOP_N,
    *,
    excluded: DataFrame | None = None,
    filtered: bool = False,
    bonus: float = fixed.GENRE_BONUS,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
    counted: DataFrame | None = None,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """Best k items per query: (qid, id, cnt, score, rank_score, rank).

    ``queries`` has (qid, vector), ``items`` (id, vector). With ``filtered``
    the queries also carry a wanted genre mask, year and count ranges and a
    genre affinity, the items mask, year and count; ranking then adds the
    genre fit. ``excluded`` (qid, id) pairs never enter a list: they travel
    with their (query, block), so the array is no longer than a block.
    Ties go to the higher count, then the lower id. ``counted`` may name a
    cheaper table with as many rows as ``queries``. More than twice
    ``head_rows`` items, neither filtered nor excluded, are scored longest first.
    """
    cut = {"chunk_rows": chunk_rows, "block_rows": block_rows, "counted": counted}
    if excluded is None and not filtered and (n_items := items.count()) > 2 * head_rows:
        return _longest_first(queries, items, k, n_items, head_rows, cut)
    return _ranked(_scored(queries, items, k, excluded, filtered, bonus, **cut), k)


def top_k_per_user(
    user_factors: DataFrame, item_factors: DataFrame, k: int = fixed.TOP_N,
    excluded: DataFrame | None = None, **kwargs,
) -> DataFrame:
    """(userId, rank, movieId, score): each user's k best films by inner product."""
    queries = user_factors.select(F.col("id").alias("qid"), F.col("features").alias("vector"))
    items = item_factors.select("id", F.col("features").alias("vector"))
    if excluded is not None:
        excluded = excluded.select(F.col("userId").alias("qid"), F.col("movieId").alias("id"))
    return top_k(queries, items, k, excluded=excluded, **kwargs).select(
        F.col("qid").alias("userId"), "rank", F.col("id").alias("movieId"), "score"
    )
