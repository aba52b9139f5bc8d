"""How good ranked lists are: precision, recall and discounted gain against held-out ratings, coverage and novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold import fixed
from filmfold.session import materialise

#: Stars from which a held-out film counts as relevant.
RELEVANT_FROM = 4


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def relevance(held_out: DataFrame, relevant_from: int = RELEVANT_FROM) -> DataFrame:
    """userId, movieId, gain of held-out films that count: 2 ** stars - 1, of the best rating if there are several."""
    best = held_out.filter(F.col("rating") >= relevant_from).groupBy("userId", "movieId").agg(F.max("rating").alias("stars"))
    return best.select("userId", "movieId", (F.pow(F.lit(2.0), "stars") - 1).alias("gain"))


def user_metrics(ranked: DataFrame, held_out: DataFrame, k: int = fixed.TOP_N, relevant_from: int = RELEVANT_FROM) -> DataFrame:
    """userId, n_relevant, n_hits, precision, recall, ndcg of each user who has a relevant held-out film.

    ``ranked`` has userId, movieId and rank from 1 on; films beyond k do not
    count, and a user without a list has zeros. Gains are graded: the ideal list
    has the user's highest gains first. Rows are joined on user and film, which
    spreads a user or film with very many ratings; the ideal list needs k rows a
    user, cut in every task before they are shuffled.
    """
    wanted = materialise(relevance(held_out, relevant_from), "relevant")
    hits = ranked.filter(F.col("rank") <= k).join(wanted, ["userId", "movieId"]).groupBy("userId").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum(F.col("gain") * discount(F.col("rank"))).alias("dcg"))
    best = Window.partitionBy("userId").orderBy(F.desc("gain"), "movieId")
    ideal = wanted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("userId").agg(
        F.sum(F.col("gain") * discount(F.col("place"))).alias("ideal"))
    counts = wanted.groupBy("userId").agg(F.count(F.lit(1)).alias("n_relevant"))
    n_hits = F.coalesce("n_hits", F.lit(0))
    return counts.join(ideal, "userId").join(hits, "userId", "left").select(
        "userId", "n_relevant", n_hits.cast("bigint").alias("n_hits"), (n_hits / k).alias("precision"),
        (n_hits / F.col("n_relevant")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


def mean_metrics(per_user: DataFrame) -> DataFrame:
    """Means over users, and how many users have a hit."""
    return per_user.agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("n_hits") > 0).alias("n_users_hit"),
        *(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")))


def renumbered(picks: DataFrame) -> DataFrame:
    """Lists after films were removed, ranks from 1 on again. A list has k rows at most."""
    order = Window.partitionBy("userId").orderBy(F.desc("score"), "movieId")
    return picks.withColumn("rank", F.row_number().over(order))


def self_information(ratings: DataFrame) -> DataFrame:
    """movieId, bits: how surprising it is that a rater knows the film, -log2 of the share of raters who rated it.

    Each (user, film) counts once. A film that everybody rated has no surprise.
    """
    pairs = materialise(ratings.select("userId", "movieId").distinct(), "rated-pairs")
    n_users = pairs.select("userId").distinct().agg(F.count(F.lit(1))).scalar()
    raters = pairs.groupBy("movieId").agg(F.count(F.lit(1)).alias("n"))
    # the smaller over the larger would give minus zero for a film that everybody rated
    return raters.select("movieId", F.log2(n_users / F.col("n")).alias("bits"))


def list_novelty(ranked: DataFrame, bits: DataFrame) -> DataFrame:
    """userId, n_films, n_unrated, novelty: the mean surprise of a list. Films that nobody rated have none that is
    finite, so they are counted apart."""
    return ranked.select("userId", "movieId").join(bits, "movieId", "left").groupBy("userId").agg(
        F.count(F.lit(1)).alias("n_films"), F.count_if(F.col("bits").isNull()).alias("n_unrated"), F.avg("bits").alias("novelty"))


def exposure(ranked: DataFrame, movies: DataFrame) -> DataFrame:
    """One row: n_films, n_shown, coverage (share of the catalogue in some list), n_slots and gini (inequality of
    exposure over all films, those never shown included: 0 when all are shown alike, near 1 when one film has it all).

    Films are first counted by how often they are shown. The window holds one
    row for each such number, of which there are no more than the square root of
    twice the slots.
    """
    shown = ranked.groupBy("movieId").agg(F.count(F.lit(1)).alias("times"))
    times = movies.select("movieId").distinct().join(shown, "movieId", "left").select(
        F.coalesce("times", F.lit(0)).cast("bigint").alias("times"))
    by_times = times.groupBy("times").agg(F.count(F.lit(1)).alias("films"))
    below = Window.orderBy("times").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_times.withColumn("lower", F.coalesce(F.sum("films").over(below), F.lit(0)))
    n, slots, films = F.sum("films"), F.sum(F.col("films") * F.col("times")), F.col("films").cast("double")
    # films of equal exposure hold the places lower + 1 to lower + films; of these, the sum of 2 * place - 1 is
    weight = films * (2 * F.col("lower") + F.col("films")) * F.col("times")
    return placed.agg(
        n.alias("n_films"), F.coalesce(F.sum(F.when(F.col("times") > 0, F.col("films"))), F.lit(0)).alias("n_shown"),
        slots.alias("n_slots"), F.sum(weight).alias("weight"),
    ).select(
        "n_films", "n_shown", F.try_divide("n_shown", "n_films").alias("coverage"), "n_slots",
        (F.try_divide("weight", F.col("n_films") * F.col("n_slots")) - 1).alias("gini"))
