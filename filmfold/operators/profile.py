"""Audits and summaries of the raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from filmfold.functions import labels as L


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """Rows and columns of a table as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_shape(df, name) for name, df in tables.items()])


def null_counts(df: DataFrame, name: str) -> DataFrame:
    """Nulls per column in long form, from one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns
    ])
    return counts.select(F.lit(name).alias("table_name"), F.inline(pairs))


def null_audit(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [null_counts(df, name) for name, df in tables.items()])


def duplicate_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that repeat an earlier row in the given (default: all) columns.

    Copies collapse before the shuffle, so one row repeated millions of times
    still moves as one row per task.
    """
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def rating_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy("rating")


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Histogram with shares in percent, the running share of at least that many
    stars, and the most frequent value. The windows see one row per star value."""
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    upwards = Window.orderBy(F.desc("rating"))
    return rating_histogram(ratings).select(
        "rating",
        "n",
        F.round(100 * F.col("n") / total, 2).alias("pct"),
        F.round(100 * F.sum("n").over(upwards) / total, 2).alias("pct_at_least"),
        (F.col("rating") == F.max_by("rating", F.struct("n", "rating")).over(everything)).alias("is_mode"),
    )


def rating_summary(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
    )


def matrix_sparsity(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Share of empty cells in users x catalogue. Users are those who rated,
    the other side is every film of the catalogue."""
    n_movies = movies.agg(F.count(F.lit(1))).scalar()
    sizes = ratings.agg(
        F.count(F.lit(1)).alias("n_ratings"), F.count_distinct("userId").alias("n_users")
    ).withColumn("n_movies", n_movies)
    cells = F.col("n_users").cast("double") * F.col("n_movies")
    return sizes.withColumn(
        "sparsity_pct", F.round((1 - F.col("n_ratings") / cells) * 100, 6)
    )


def rating_time_range(ratings: DataFrame) -> DataFrame:
    """First and last rating time."""
    return ratings.agg(
        F.min("timestamp").alias("first_epoch"), F.max("timestamp").alias("last_epoch")
    ).select(
        "first_epoch",
        "last_epoch",
        F.date_format(L.rated_at(F.col("first_epoch")), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
        F.date_format(L.rated_at(F.col("last_epoch")), "yyyy-MM-dd HH:mm:ss").alias("last_at"),
    )


def user_demographics(users: DataFrame) -> DataFrame:
    """Users with their age and occupation codes spelled out."""
    return users.select(
        "userId",
        "gender",
        L.age_label(F.col("age")).alias("age_group"),
        L.occupation_label(F.col("occupation")).alias("occupation_name"),
        "zip",
    )
