"""The film feature table: counts, means, genre masks and quantised vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmfold import fixed
from filmfold.functions import genres as G, numbers as N, ranges as R, titles as T
from filmfold.operators import popularity


def film_table(
    ratings: DataFrame, movies: DataFrame, item_factors: DataFrame,
    min_ratings: int = fixed.MIN_FILM_RATINGS,
) -> DataFrame:
    """Films with a vector and enough ratings. Ratings shrink to one row per film
    before any join, and thin films go before they meet the catalogue."""
    counts = popularity.film_counts(ratings).filter(F.col("cnt") >= min_ratings)
    vectors = item_factors.select(
        F.col("id").alias("movieId"), N.quantise(F.col("features")).alias("q")
    )
    return counts.join(vectors, "movieId").join(movies, "movieId").select(
        "movieId",
        "title",
        T.release_year_or_zero(F.col("title")).alias("year"),
        G.genre_mask(G.split_genres(F.col("genres"))).alias("mask"),
        F.col("cnt").cast("int").alias("cnt"),
        F.bround(10.0 * F.col("total") / F.col("cnt"), 0).cast("int").alias("mean10"),
        "q",
    )


def decode_films(table: DataFrame) -> DataFrame:
    """Film table with means and vectors back on their own scale."""
    return table.select(
        "movieId", "title", "year", "mask", "cnt",
        (F.col("mean10") / 10).alias("mean"),
        G.mask_genres(F.col("mask")).alias("genres"),
        N.dequantise(F.col("q")).alias("features"),
    )


def with_bayesian_score(films: DataFrame, weight: int = fixed.BAYES_WEIGHT) -> DataFrame:
    """Add ``score``: a film's mean, with the mean of all ratings counted in as ``weight`` ratings more.

    The mean of all ratings is a scalar subquery."""
    prior = films.agg(F.sum(F.col("mean") * F.col("cnt")) / F.sum("cnt")).scalar()
    return films.withColumn(
        "score", (F.col("mean") * F.col("cnt") + prior * weight) / (F.col("cnt") + weight)
    )


def films_by_era(films: DataFrame) -> DataFrame:
    """(era, film) rows; the ranges are literals, so this is a projection, not a join."""
    return films.select(F.explode(R.matching_eras(F.col("year"))).alias("era"), *films.columns)


def films_by_reach(films: DataFrame, reach: dict = fixed.REACH) -> DataFrame:
    return films.select(F.explode(R.matching_reaches(F.col("cnt"), reach)).alias("reach"), *films.columns)


def films_by_mood(films: DataFrame) -> DataFrame:
    """(mood, film) rows for films sharing any genre with the mood."""
    matching = F.array_compact(F.array(*[
        F.when(G.any_genre(F.col("mask"), F.lit(_mask(names))), F.lit(mood))
        for mood, names in fixed.MOODS.items()
    ]))
    return films.select(F.explode(matching).alias("mood"), *films.columns)


def _mask(names: list[str]) -> int:
    return sum(1 << fixed.GENRES.index(name) for name in names)


def rating_pool(films: DataFrame, min_ratings: int = fixed.POOL_MIN_RATINGS) -> DataFrame:
    """Well-known films of each mood to ask a newcomer about, most-rated first."""
    pool = films_by_mood(films.filter(F.col("cnt") >= min_ratings))
    return pool.orderBy("mood", F.desc("cnt"), "movieId")
