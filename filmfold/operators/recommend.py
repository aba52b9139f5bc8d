"""Recommendation lists: exclusion, metadata, fallback and routing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold import fixed
from filmfold.functions import genres as G, numbers as N, titles as T
from filmfold.operators import scoring
from filmfold.operators.skew import plain_join
from filmfold.sources import layout

KEYS = ["userId", "movieId"]

#: A single user's answer.
ANSWER = pa.schema([("userId", pa.int64()), ("movieId", pa.int64()), ("score", pa.float64()), ("title", pa.string()),
                    ("genres", pa.string())])


def rated_pairs(ratings: DataFrame) -> DataFrame:
    """Distinct (userId, movieId), kept in long form: a list of films per user
    would put a very active user into a single row."""
    return ratings.select(*KEYS).distinct()


def user_history(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """Ratings of the given users; one equality filter per user as a semi join.
    Users may repeat, and one user may hold much of the ratings."""
    return plain_join(ratings, users.select("userId").distinct(), ["userId"], "left_semi")


def exclude_rated(picks: DataFrame, ratings: DataFrame) -> DataFrame:
    """Drop films the user has rated.

    Ratings are first cut down to the pairs that were picked. While the picks
    are small they are the broadcast side and the ratings are not shuffled at
    all; otherwise both sides meet on (user, film), which spreads a hot user
    or film over all tasks.
    """
    picked = ratings.select(*KEYS).join(picks.select(*KEYS), KEYS, "left_semi").distinct()
    return picks.join(picked, KEYS, "left_anti")


def with_metadata(picks: DataFrame, movies: DataFrame) -> DataFrame:
    """Attach titles and genres; picks without a catalogue entry keep nulls."""
    return picks.join(movies, "movieId", "left")


def with_default_metadata(picks: DataFrame, movies: DataFrame) -> DataFrame:
    """Like :func:`with_metadata`, with a stand-in title and no genres for the rest."""
    stand_in = F.concat(F.lit("Movie "), F.col("movieId").cast("string"))
    return (
        with_metadata(picks, movies)
        .withColumn("title", F.coalesce("title", stand_in))
        .withColumn("genres", F.coalesce("genres", F.lit("")))
    )


def lookup_movies(movies: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalogue rows of the given ids."""
    return movies.join(ids.select("movieId").distinct(), "movieId", "left_semi")


def known_users(users: DataFrame, user_factors: DataFrame) -> DataFrame:
    """Flag the users the model has a vector for, without counting on the driver."""
    vectors = user_factors.select(F.col("id").alias("userId"), F.lit(True).alias("known"))
    return users.join(vectors, "userId", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def valid_requests(raw_ids: DataFrame, column: str = "raw_id") -> DataFrame:
    """Trim request ids and flag the usable ones; bad rows stay, without a userId."""
    trimmed = F.regexp_replace(column, r"^\s+|\s+$", "")
    valid = F.rlike(trimmed, F.lit(fixed.USER_ID_PATTERN))
    return raw_ids.select(
        column, valid.alias("is_valid"), F.when(valid, trimmed).cast("bigint").alias("userId")
    )


def rejected_requests(raw_ids: DataFrame, column: str = "raw_id") -> DataFrame:
    """The request ids that :func:`valid_requests` does not accept, and why."""
    trimmed = F.regexp_replace(F.coalesce(column, F.lit("")), r"^\s+|\s+$", "")
    reason = (
        F.when(trimmed == "", F.lit("blank"))
        .when(~F.rlike(trimmed, F.lit(r"^\d+$")), F.lit("not a number"))
        .when(~F.rlike(trimmed, F.lit(fixed.USER_ID_PATTERN)), F.lit("too long"))
    )
    return raw_ids.select(column, reason.alias("reason")).filter("reason IS NOT NULL")


def picks_from_vectors(
    user_factors: DataFrame, item_factors: DataFrame, ratings: DataFrame, k: int = fixed.TOP_N
) -> DataFrame:
    """Top k films of every user who has both ratings and a vector."""
    raters = ratings.select(F.col("userId").alias("id")).distinct()
    users = user_factors.join(raters, "id", "left_semi")
    return scoring.top_k_per_user(users, item_factors, k, counted=user_factors)


def picks_from_model(model, k: int = fixed.TOP_N, users: DataFrame | None = None) -> DataFrame:
    """Top k films per user of a trained model, for all users or a users table.

    Both go through the blocked scorer, so a user gets the same list either way.
    """
    vectors = model.userFactors
    if users is not None:
        vectors = vectors.join(users.select(F.col("userId").alias("id")).distinct(), "id", "left_semi")
    return scoring.top_k_per_user(vectors, model.itemFactors, k)


def answer_users(picks: DataFrame, ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Lists as they are shown: rated films removed, the rest numbered anew from the best, titles and genres
    attached, scores rounded. A list may be shorter than it was."""
    kept = exclude_rated(picks, ratings)
    order = Window.partitionBy("userId").orderBy(F.desc("score"), "movieId")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return with_metadata(ranked, movies).select(
        "userId", "rank", "movieId", "title", "genres", N.round_half_even(F.col("score")).alias("predictedRating")
    )


def picks_for_user(
    user_factors: DataFrame, item_factors: DataFrame, user_id: int, k: int = fixed.TOP_N
) -> DataFrame:
    """Top k films of a single user: one pass over the film vectors, no shuffle.
    Each task keeps k rows. An unknown user has no rows."""
    vector = user_factors.filter(F.col("id") == user_id).select("features").scalar()
    scored = item_factors.withColumn("u", vector).select(
        F.lit(user_id).cast("bigint").alias("userId"), F.col("id").alias("movieId"),
        N.dot(F.col("features"), F.col("u")).alias("score"),
    )
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "movieId").limit(k)


def recommend_user(
    user_factors: DataFrame, item_factors: DataFrame, ratings: DataFrame, movies: DataFrame,
    user_id: int, k: int = fixed.TOP_N,
) -> DataFrame:
    """One user's answer: best k, rated ones removed, titles attached, best first."""
    seen = rated_pairs(ratings.filter(F.col("userId") == user_id))
    kept = picks_for_user(user_factors, item_factors, user_id, k).join(seen, KEYS, "left_anti")
    return with_metadata(kept, movies).orderBy(F.desc("score"), "movieId")


def answer_user(
    vectors: DataFrame, item_factors: DataFrame, ratings: layout.UserTable, movies: DataFrame,
    user_id: int, k: int = fixed.TOP_N,
) -> DataFrame:
    """:func:`recommend_user` from clustered tables, as three short jobs.

    ``vectors`` (userId, features) is bucketed by user and ``movies`` sorted by
    id, so the vector, the user's rows among the k picks and their titles each
    come from one file or a few row groups; only the film vectors are scanned,
    and each task keeps k of them. The vector and the k picks pass through the
    driver, and nothing that grows. Expressions are SQL text, since building
    them call by call takes longer than the jobs.
    """
    spark, user_id = vectors.sparkSession, int(user_id)
    mine = vectors.filter(f"userId = {user_id}").select("features").head(1)
    if not mine:
        return spark.createDataFrame(ANSWER.empty_table())
    vector = ", ".join(f"{float(x)!r}D" for x in mine[0]["features"])
    score = (f"aggregate(zip_with(features, array({vector}), (a, b) -> cast(a AS double) * b), 0D, (s, x) -> s + x)")
    picks = item_factors.selectExpr("id AS movieId", f"{score} AS score").filter("score IS NOT NULL") \
        .orderBy("score", "movieId", ascending=[False, True]).limit(k).collect()
    if not picks:
        return spark.createDataFrame(ANSWER.empty_table())
    among = f"movieId IN ({', '.join(str(p.movieId) for p in picks)})"
    seen = layout.history(ratings, user_id).filter(among).selectExpr("movieId", "true AS seen", "NULL AS title", "NULL AS genres")
    found = seen.union(movies.filter(among).selectExpr("movieId", "false", "title", "genres")).collect()
    gone = {r.movieId for r in found if r.seen}
    titles = {r.movieId: (r.title, r.genres) for r in found if not r.seen}
    rows = [(user_id, p.movieId, p.score, *titles.get(p.movieId, (None, None))) for p in picks if p.movieId not in gone]
    columns = [list(c) for c in zip(*rows)] or [[]] * len(ANSWER)
    return spark.createDataFrame(pa.table(columns, schema=ANSWER))  # from Arrow: rows need no Python worker later


def nested_picks(picks: DataFrame, users: DataFrame) -> DataFrame:
    """One row per user with the remaining picks in order; empty lists included.
    A list holds at most k entries."""
    entry = F.struct("rank", "movieId", N.round_half_even(F.col("score")).alias("score"))
    lists = picks.groupBy("userId").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    ordered = F.transform(
        F.col("ranked"), lambda p: F.struct(p["movieId"].alias("movieId"), p["score"].alias("score"))
    )
    empty = F.array().cast("array<struct<movieId:bigint,score:double>>")
    return users.select("userId").join(lists, "userId", "left").select(
        "userId", F.coalesce(ordered, empty).alias("picks")
    )


def list_sizes(nested: DataFrame) -> DataFrame:
    """How many users got how many picks after exclusion."""
    return nested.groupBy(F.size("picks").alias("n_picks")).agg(F.count(F.lit(1)).alias("n_users"))


def used_films(picks: DataFrame, popular: DataFrame) -> DataFrame:
    """Distinct films that appear in any list."""
    return picks.select("movieId").union(popular.select("movieId")).distinct()


def route(
    users: DataFrame, user_factors: DataFrame, picks: DataFrame, movies: DataFrame, popular: Column
) -> DataFrame:
    """Answer a table of user ids: own picks for known users, the popular list for
    the rest. ``popular`` is one short array value, so no join is needed for it."""
    flagged = known_users(users, user_factors)
    own = (
        with_metadata(flagged.filter("known").select("userId").join(picks, "userId"), movies)
        .select(
            "userId", F.lit("personalized").alias("type"), "rank", "movieId", "title", "genres",
            N.round_half_even(F.col("score")).alias("predictedRating"),
        )
    )
    fallback = flagged.filter(~F.col("known")).select("userId", F.inline(popular)).select(
        "userId", F.lit("popular").alias("type"), "rank", "movieId", "title", "genres",
        F.lit(None).cast("double").alias("predictedRating"),
    )
    return own.unionByName(fallback)


def serve(users: DataFrame, table: DataFrame, movies: DataFrame, popular: Column) -> DataFrame:
    """Answer from precomputed picks: a user without a row gets the popular list."""
    stored = users.select("userId").join(table, "userId", "left")
    own = stored.filter(F.col("picks").isNotNull()).select(
        "userId", F.posexplode("picks").alias("pos", "pick")
    ).select(
        "userId", F.lit("personalized").alias("type"), (F.col("pos") + 1).alias("rank"),
        F.col("pick.movieId").alias("movieId"), F.col("pick.score").alias("predictedRating"),
    )
    fallback = stored.filter(F.col("picks").isNull()).select("userId", F.inline(popular)).select(
        "userId", F.lit("popular").alias("type"), "rank", "movieId",
        F.lit(None).cast("double").alias("predictedRating"), "title", "genres",
    )
    return with_default_metadata(own, movies).unionByName(fallback)


def normalise_movies(df: DataFrame) -> DataFrame:
    """Result rows in the shape every list shares."""
    optional = {
        "predictedRating": F.lit(None).cast("double"), "posterUrl": F.lit(None).cast("string"),
    }
    present = {c: F.col(c) if c in df.columns else default for c, default in optional.items()}
    title = F.col("title")
    return df.select(
        F.col("movieId").alias("id"),
        title.alias("rawTitle"),
        T.display_title(title).alias("title"),
        T.display_year(title).alias("year"),
        G.split_genres(F.col("genres")).alias("genres"),
        present["predictedRating"].alias("predicted"),
        F.nullif(present["posterUrl"], F.lit("")).alias("posterUrl"),
    )


def genre_mix(picks: DataFrame, key: str = "userId") -> DataFrame:
    """Share of each genre in each list; a film with n genres gives 1/n to each.
    Lists are short, so each key holds at most one row per genre."""
    weighted = picks.withColumn("names", G.split_genres(F.col("genres"))).select(
        key, F.explode("names").alias("genre"), (F.lit(1.0) / F.size("names")).alias("weight")
    )
    per_genre = weighted.groupBy(key, "genre").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(key))
    return per_genre.select(key, "genre", (F.col("weight") / total).alias("share"))
