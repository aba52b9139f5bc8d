"""Counts and means per film, and the rankings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold import fixed


def film_counts(ratings: DataFrame) -> DataFrame:
    """Ratings and star total per film; combined in each task before the shuffle,
    so a film with a third of all ratings costs one row per task."""
    return ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("rating").alias("total")
    )


def film_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Count and mean with titles; aggregated first, so the join moves one row per film."""
    stats = film_counts(ratings).select(
        "movieId",
        F.col("cnt").alias("rating_count"),
        (F.col("total") / F.col("cnt")).alias("average_rating"),
    )
    return stats.join(movies, "movieId")


def most_rated(ratings: DataFrame, n: int = fixed.TOP_N) -> DataFrame:
    """The n most-rated films, ties to the lower id; a per-task top n, then a merge."""
    return (
        ratings.groupBy("movieId")
        .agg(F.count(F.lit(1)).alias("rating_count"), F.avg("rating").alias("average_rating"))
        .orderBy(F.desc("rating_count"), "movieId")
        .limit(n)
    )


def most_rated_titles(ratings: DataFrame, movies: DataFrame, n: int = fixed.TOP_N) -> DataFrame:
    return most_rated(ratings, n).join(movies, "movieId")


def top_rated(
    ratings: DataFrame, movies: DataFrame, min_support: int = fixed.MIN_SUPPORT, n: int = fixed.TOP_N
) -> DataFrame:
    """Best mean among films with enough ratings."""
    return (
        film_stats(ratings, movies)
        .filter(F.col("rating_count") >= min_support)
        .orderBy(F.desc("average_rating"), "movieId")
        .limit(n)
    )


def popular_list(ratings: DataFrame, movies: DataFrame, n: int = fixed.TOP_N) -> DataFrame:
    """Fallback list in rank order. A film missing from the catalogue is left out,
    the others keep the rank they had."""
    by_rank = Window.orderBy(F.desc("rating_count"), "movieId")  # n rows only
    ranked = most_rated(ratings, n).withColumn("rank", F.row_number().over(by_rank))
    return ranked.join(movies, "movieId").select("rank", "movieId", "title", "genres")


def popular_array(ratings: DataFrame, movies: DataFrame, n: int = fixed.TOP_N) -> Column:
    """The fallback list as one array value: a scalar subquery, at most n entries."""
    entry = F.struct("rank", "movieId", "title", "genres")
    return (
        popular_list(ratings, movies, n)
        .agg(F.array_sort(F.collect_list(entry)).alias("popular"))
        .scalar()
    )
