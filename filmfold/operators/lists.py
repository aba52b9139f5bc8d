"""Ordered lists: ranks, keep-first de-duplication, preferred-first limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from filmfold import fixed


def number_rows(df: DataFrame, key: str, *order) -> DataFrame:
    """Rank 1..n within each key, with the two-digit label shown next to it.
    Meant for result lists, which hold at most a few rows per key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).withColumn(
        "rank_label", F.when(F.col("rank") < 100, F.lpad(F.col("rank").cast("string"), 2, "0"))
        .otherwise(F.col("rank").cast("string"))
    )


def join_lists(first: DataFrame, second: DataFrame, pos: str = "pos") -> DataFrame:
    """One list after the other, order kept in (list_no, pos)."""
    return first.withColumn("list_no", F.lit(1)).unionByName(second.withColumn("list_no", F.lit(2)))


def dedup_keep_first(df: DataFrame, key: str, *position: str) -> DataFrame:
    """First row of each key in list order, as an aggregate: copies of a hot key
    collapse in every task before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in position]
    first = F.min(F.struct(*position, *rest)).alias("first")
    return df.groupBy(key).agg(first).select(key, *[F.col("first")[c].alias(c) for c in (*position, *rest)])


def preferred_first(df: DataFrame, flag: str, position: list[str], n: int = fixed.POSTER_WALL) -> DataFrame:
    """Rows with the flag first, original order otherwise, at most n."""
    return df.orderBy(F.desc(flag), *position).limit(n)


def preferred_only_if_enough(
    df: DataFrame, flag: str, position: list[str], n: int = fixed.POSTER_RING
) -> DataFrame:
    """Only flagged rows when there are at least n of them, otherwise all rows."""
    flagged = df.agg(F.count_if(flag)).scalar()
    return df.filter(F.col(flag) | (flagged < n)).orderBy(*position).limit(n)
