"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Thresholds are the ones below where the defaults are meant for a million
ratings; the given tables have about 30 ratings per film at every size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filmfold import fixed, schemas
from filmfold.functions import genres as G, numbers as N, ranges as R, titles as T
from filmfold.operators import (
    films as FO, foldin, implicit, lists, matching, model, popularity, profile, ranking, recommend, scoring,
)
from filmfold.plans import artifacts as A
from filmfold.session import materialise, scratch_path
from filmfold.sources import layout, readers, rejects, slots, versions, views as V, writers

MIN_SUPPORT = 40
MIN_FILM_RATINGS = 20
POOL_MIN = 38
TIERS = [40, 35, 25]
ONE_USER = 1
SLOT_FILMS = 100
REACH = {"popular": (40, None), "balanced": (30, None), "gems": (20, 35)}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _films(spark, sf):
    return FO.decode_films(A.film_table(spark, sf, MIN_FILM_RATINGS))


def _scored_films(spark, sf):
    return FO.with_bayesian_score(_films(spark, sf))


def _requests(spark, sf):
    return V.requests(spark, sf).withColumn("genres", G.mood_genres(F.col("mood")))


def _prepared(spark, sf):
    return foldin.prepare_requests(_requests(spark, sf))


def _rated(spark, sf):
    return A.written(
        spark, sf, "rated", lambda: foldin.rated_films(A.reactions_table(spark, sf), _films(spark, sf))
    )


def _equations(spark, sf):
    """The equations of all requests, written once for the queries that read them."""
    return A.written(spark, sf, "equations", lambda: foldin.normal_equations(
        _prepared(spark, sf), _rated(spark, sf), _scored_films(spark, sf), rank=fixed.RANK, tiers=TIERS
    ))


def _customers(spark, sf):
    """Everybody who may ask, known to the model or not."""
    return V.table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("userId"))


def _visitors(spark, sf):
    """User ids seen in the event log."""
    return V.table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("userId"))


def _order_ids(spark, sf):
    """Ids to look up, most of them not in the catalogue."""
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("movieId"))


def _named_tables(spark, sf):
    return {"ratings": V.ratings(spark, sf), "movies": V.movies(spark, sf), "users": V.users(spark, sf)}


# --- popularity and profile ---------------------------------------------------

@query
def popular_movies(spark, sf):
    top = popularity.most_rated_titles(V.ratings(spark, sf), V.movies(spark, sf))
    return top.select("movieId", "title", "rating_count", F.round("average_rating", 6).alias("average_rating"))


@query
def top10_most_rated(spark, sf):
    top = popularity.most_rated_titles(V.ratings(spark, sf), V.movies(spark, sf))
    return top.select("movieId", "title", "rating_count")


@query
def movie_stats(spark, sf):
    stats = popularity.film_stats(V.ratings(spark, sf), V.movies(spark, sf))
    return stats.withColumn("average_rating", F.round("average_rating", 6))


@query
def top_rated_min_support(spark, sf):
    top = popularity.top_rated(V.ratings(spark, sf), V.movies(spark, sf), MIN_SUPPORT)
    return top.select("movieId", "title", "rating_count", F.round("average_rating", 6).alias("average_rating"))


@query
def popular_fallback(spark, sf):
    return popularity.popular_list(V.ratings(spark, sf), V.movies(spark, sf))


@query
def table_shapes(spark, sf):
    return profile.table_shapes(_named_tables(spark, sf))


@query
def null_audit(spark, sf):
    tables = _named_tables(spark, sf)
    tables["posters"] = tables["movies"].join(V.posters(spark, sf), "movieId", "left")
    tables["links"] = V.links(spark, sf)
    return profile.null_audit(tables)


@query
def duplicate_count(spark, sf):
    ratings = V.ratings(spark, sf)
    whole = profile.duplicate_rows(ratings).withColumn("scope", F.lit("all columns"))
    pairs = profile.duplicate_rows(ratings, "userId", "movieId").withColumn("scope", F.lit("user and movie"))
    return whole.unionByName(pairs)


@query
def rating_histogram(spark, sf):
    return profile.rating_histogram(V.ratings(spark, sf))


@query
def rating_distribution_pct(spark, sf):
    return profile.rating_distribution(V.ratings(spark, sf))


@query
def rating_summary(spark, sf):
    return profile.rating_summary(V.ratings(spark, sf))


@query
def matrix_sparsity(spark, sf):
    return profile.matrix_sparsity(V.ratings(spark, sf), V.movies(spark, sf))


@query
def rating_time_range(spark, sf):
    return profile.rating_time_range(V.ratings(spark, sf))


@query
def user_demographics(spark, sf):
    return profile.user_demographics(V.users(spark, sf))


# --- sources and sinks --------------------------------------------------------

@query
def scan_dat_ratings(spark, sf):
    path = scratch_path(spark, "ratings.dat")
    writers.write_dat(V.ratings(spark, sf), path)
    return readers.read_dat_ratings(spark, path)


@query
def scan_dat_movies(spark, sf):
    path = scratch_path(spark, "movies.dat")
    writers.write_dat(V.movies(spark, sf), path, readers.LATIN_1)
    return readers.read_dat_movies(spark, path)


@query
def scan_dat_users(spark, sf):
    path = scratch_path(spark, "users.dat")
    writers.write_dat(V.users(spark, sf), path, readers.LATIN_1)
    return readers.read_dat_users(spark, path)


@query
def scan_csv_ratings(spark, sf):
    path = scratch_path(spark, "ratings.csv")
    writers.write_csv(V.ratings(spark, sf), path)
    return readers.read_csv(spark, path, schemas.RATINGS)


@query
def sink_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "movies.csv")
    writers.write_csv(V.movies(spark, sf), path)
    return readers.read_csv(spark, path, schemas.MOVIES)


@query
def sink_full_refresh(spark, sf):
    """Load twice; the second load replaces the first, it does not add to it."""
    path = scratch_path(spark, "users")
    users = V.users(spark, sf)
    versions.refresh(users, path)
    versions.refresh(users, path)
    stored = versions.read(spark, path, schemas.USERS)
    return stored.agg(F.count(F.lit(1)).alias("n_users"), F.count_distinct("zip").alias("n_zip"))


@query
def refresh_versions(spark, sf):
    """Ratings by stars as two loads leave them: the second has those of five stars only, the first is still there."""
    path = scratch_path(spark, "ratings")
    ratings = V.ratings(spark, sf)
    first = versions.refresh(ratings, path)
    versions.refresh(ratings.filter("rating = 5"), path)
    tables = {"current": versions.read(spark, path, schemas.RATINGS),
              "before": spark.read.schema(schemas.RATINGS).parquet(f"{path}/{first.folder}")}
    return reduce(DataFrame.unionByName, [
        profile.rating_histogram(df).withColumn("version", F.lit(name)) for name, df in tables.items()])


@query
def counts_while_writing(spark, sf):
    """Rows and nulls of each column, observed while the tables are written."""
    tables = _named_tables(spark, sf)
    tables["posters"] = tables["movies"].join(V.posters(spark, sf), "movieId", "left")
    tables["links"] = V.links(spark, sf)
    return versions.column_counts(
        {name: versions.refresh(df, scratch_path(spark, name)) for name, df in tables.items()}, spark)


@query
def links_nonblank(spark, sf):
    path = scratch_path(spark, "links.csv")
    writers.write_csv(V.links(spark, sf), path)
    return readers.read_links(spark, path)


@query
def json_map_explode(spark, sf):
    path = scratch_path(spark, "posters.json")
    writers.write_json_map(V.posters(spark, sf), path)
    return readers.read_json_map(spark, path)


def _checked(checked):
    """Accepted rows and rejects in one table."""
    return checked.rows.select(
        *checked.columns, F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"), "reason")


@query
def ratings_checked(spark, sf):
    """A file of ratings in which some lines are broken: a field missing or too many, no number, no rating."""
    path, kind = scratch_path(spark, "ratings-broken.dat"), F.col("movieId") % 9
    stars = F.col("rating").cast("string")
    line = F.concat_ws(
        "::", F.col("userId").cast("string"), F.col("movieId").cast("string"),
        F.when(kind == 1, F.concat(F.lit("x"), stars)).when(kind == 2, F.lit("")).otherwise(stars),
        F.when(kind != 0, F.col("timestamp").cast("string")), F.when(kind == 3, F.lit("more")))
    V.ratings(spark, sf).select(line.alias("value")).write.text(path)
    return _checked(rejects.read_dat_ratings(spark, path))


@query
def movies_checked(spark, sf):
    """The catalogue as a CSV file with quoted titles; some ids are no numbers, some titles are missing."""
    path, key = scratch_path(spark, "movies-broken.csv"), F.col("movieId")
    writers.write_csv(V.movies(spark, sf).select(
        F.when(key % 5 == 0, F.concat(F.lit("no. "), key)).otherwise(key.cast("string")).alias("movieId"),
        F.when(key % 7 != 0, F.concat(F.lit('"'), "title", F.lit('", cut'))).alias("title"), "genres"), path)
    return _checked(rejects.read_csv(spark, path, schemas.MOVIES, ["movieId", "title"]))


@query
def json_map_checked(spark, sf):
    """Poster addresses as JSON lines, of which some are cut off and some have no film id."""
    path, key = scratch_path(spark, "posters-broken.json"), F.col("movieId")
    name = F.when(key % 5 == 0, F.concat(F.lit("film "), key)).otherwise(key.cast("string"))
    line = F.when(key % 7 == 0, F.concat(F.lit("["), key)).otherwise(F.to_json(F.create_map(name, F.col("url"))))
    V.posters(spark, sf).select(line.alias("value")).write.text(path)
    return _checked(rejects.read_json_map(spark, path))


@query
def requests_table(spark, sf):
    return _requests(spark, sf).select("reqId", "mood", F.array_join("genres", "|").alias("genres"), "era", "reach")


@query
def lookup_movies_by_ids(spark, sf):
    return recommend.lookup_movies(V.movies(spark, sf), V.posters(spark, sf).select("movieId"))


@query
def export_films(spark, sf):
    """The written film table, vector as text."""
    return A.film_table(spark, sf, MIN_FILM_RATINGS).select(
        "movieId", "title", "year", "mask", "cnt", "mean10", F.array_join("q", ",").alias("q")
    )


@query
def decode_films(spark, sf):
    path = scratch_path(spark, "films.json")
    writers.write_film_lines(A.film_table(spark, sf, MIN_FILM_RATINGS), path)
    f = readers.read_film_lines(spark, path)
    return f.select(
        "movieId", "title", "year", "mask", "cnt", "mean",
        F.array_join("genres", "|").alias("genres"),
        *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(fixed.RANK)],
    )


@query
def export_user_picks(spark, sf):
    """Written pick table, unpacked again."""
    picks = A.vector_picks(spark, sf)
    raters = A.vector_top(spark, sf).select("userId").distinct()
    path = scratch_path(spark, "picks")
    writers.write_pick_table(recommend.nested_picks(picks, raters), path)
    table = readers.read_pick_table(spark, path)
    return table.select("userId", F.posexplode_outer("picks").alias("pos", "pick")).select(
        "userId", "pos", F.col("pick.movieId").alias("movieId"), F.col("pick.score").alias("score")
    )


@query
def serve_precomputed(spark, sf):
    picks = A.vector_picks(spark, sf)
    raters = A.vector_top(spark, sf).select("userId").distinct()
    path = scratch_path(spark, "picks")
    writers.write_pick_table(recommend.nested_picks(picks, raters), path)
    movies = V.movies(spark, sf)
    popular = popularity.popular_array(V.ratings(spark, sf), movies)
    served = recommend.serve(_customers(spark, sf), readers.read_pick_table(spark, path), movies, popular)
    return served.select("userId", "type", "rank", "movieId", "title", "genres", "predictedRating")


# --- projections, filters and scalar functions --------------------------------

@query
def als_input(spark, sf):
    return model.als_input(V.ratings(spark, sf))


@query
def user_history(spark, sf):
    return recommend.user_history(V.ratings(spark, sf), _visitors(spark, sf)).select("userId", "movieId", "rating")


@query
def distinct_users(spark, sf):
    return V.ratings(spark, sf).select("userId").distinct()


@query
def rated_sets(spark, sf):
    return recommend.rated_pairs(V.ratings(spark, sf))


@query
def known_user_flag(spark, sf):
    return recommend.known_users(_customers(spark, sf), V.user_factors(spark, sf))


def _raw_ids(spark, sf):
    customer = V.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    raw = F.inline(F.array(
        F.struct(F.concat(F.lit("  "), key, F.lit(" ")).alias("raw_id")),
        F.struct(F.col("c_name").alias("raw_id")),
        F.struct(F.concat(F.lit("12345"), F.lpad(key, 5, "0")).alias("raw_id")),
        F.struct(F.concat(key, F.lit(".5")).alias("raw_id")),
    ))
    return customer.select(raw)


@query
def validate_ids(spark, sf):
    return recommend.valid_requests(_raw_ids(spark, sf))


@query
def rejected_ids(spark, sf):
    return recommend.rejected_requests(_raw_ids(spark, sf))


@query
def genres_exploded(spark, sf):
    return V.movies(spark, sf).select("movieId", F.explode(G.split_genres(F.col("genres"))).alias("genre"))


@query
def genre_mask(spark, sf):
    names = G.split_genres(F.col("genres"))
    return V.movies(spark, sf).select("movieId", G.genre_mask(names).alias("mask")).withColumn(
        "decoded", F.array_join(G.mask_genres(F.col("mask")), "|")
    )


@query
def mood_genres(spark, sf):
    return _requests(spark, sf).select("reqId", "mood", F.explode("genres").alias("genre"))


@query
def title_year(spark, sf):
    title = F.col("title")
    return V.movies(spark, sf).select(
        "movieId", T.release_year(title).alias("year"), T.release_year_or_zero(title).alias("year_or_zero")
    )


@query
def title_display(spark, sf):
    return V.movies(spark, sf).select(
        "movieId", T.display_title(F.col("title")).alias("display"), T.display_year(F.col("title")).alias("year")
    )


@query
def title_variants(spark, sf):
    return V.movies(spark, sf).select("movieId", F.posexplode(T.search_names(F.col("title"))).alias("pos", "name"))


@query
def normalise_movies(spark, sf):
    movies = V.movies(spark, sf).join(
        V.posters(spark, sf).withColumnRenamed("url", "posterUrl"), "movieId", "left"
    )
    return recommend.normalise_movies(movies).withColumn("genres", F.array_join("genres", "|"))


@query
def quantise_features(spark, sf):
    return V.item_factors(spark, sf).select(
        "id", F.posexplode(N.quantise(F.col("features"))).alias("k", "q")
    )


@query
def clamp_score(spark, sf):
    score = F.col("o_totalprice") / 90000
    return V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.round(score, 6).alias("score"),
        N.round_half_even(score).alias("stored"),
        N.round_half_up(score).alias("reported"),
        N.shown_score(score).alias("shown"),
    )


@query
def films_by_era(spark, sf):
    return FO.films_by_era(_films(spark, sf)).select("era", "movieId", "year")


@query
def films_by_reach(spark, sf):
    return FO.films_by_reach(_films(spark, sf), REACH).select("reach", "movieId", "cnt")


@query
def films_any_genre(spark, sf):
    return FO.films_by_mood(_films(spark, sf)).select("mood", "movieId", "mask")


# --- joins, lists and lookups -------------------------------------------------

@query
def enrich_left(spark, sf):
    return recommend.with_metadata(_order_ids(spark, sf), V.movies(spark, sf))


@query
def enrich_with_default(spark, sf):
    return recommend.with_default_metadata(_order_ids(spark, sf), V.movies(spark, sf))


@query
def poster_coalesce(spark, sf):
    own = V.links(spark, sf).select("movieId", F.col("tmdbId").alias("url"))
    return matching.own_or_saved_url(V.movies(spark, sf), own, V.posters(spark, sf))


@query
def title_match(spark, sf):
    return matching.match_titles(V.movies(spark, sf), V.external_catalogue(spark, sf))


@query
def poster_resolve(spark, sf):
    return matching.resolve_posters(
        V.movies(spark, sf), V.links(spark, sf), V.external_catalogue(spark, sf)
    )


def _upserted(spark, sf):
    return matching.upsert_posters(
        V.posters(spark, sf), V.movies(spark, sf), V.links(spark, sf), V.external_catalogue(spark, sf)
    )


@query
def poster_upsert(spark, sf):
    """Merged map, written and read back."""
    path = scratch_path(spark, "posters.json")
    writers.write_json_map(_upserted(spark, sf), path)
    return readers.read_json_map(spark, path)


@query
def poster_upsert_slots(spark, sf):
    """The same map in slots of ids, of which the upsert rewrites those that get an entry."""
    path, saved = scratch_path(spark, "poster-slots"), V.posters(spark, sf)
    slots.upsert(saved, path, SLOT_FILMS)
    found = matching.found_posters(saved, V.movies(spark, sf), V.links(spark, sf), V.external_catalogue(spark, sf))
    slots.upsert(found, path, SLOT_FILMS)
    return slots.read(spark, path).select("movieId", "url")


@query
def poster_missing(spark, sf):
    path = scratch_path(spark, "posters-missing.tsv")
    writers.write_tsv(matching.missing_posters(V.movies(spark, sf), _upserted(spark, sf)), path)
    return spark.read.csv(path, sep="\t", schema="movieId bigint, title string", quote="")


@query
def match_coverage(spark, sf):
    return matching.match_coverage(V.movies(spark, sf), _upserted(spark, sf))


def _shelf(spark, sf):
    """Most-rated films first, then the whole catalogue; every film once."""
    movies = V.movies(spark, sf)
    top = popularity.popular_list(V.ratings(spark, sf), movies).select(F.col("rank").alias("pos"), "movieId", "title")
    rest = movies.select(F.col("movieId").alias("pos"), "movieId", "title")
    return lists.join_lists(top, rest)


@query
def dedup_keep_first(spark, sf):
    return lists.dedup_keep_first(_shelf(spark, sf), "movieId", "list_no", "pos")


@query
def poster_first(spark, sf):
    shelf = lists.dedup_keep_first(_shelf(spark, sf), "movieId", "list_no", "pos")
    urls = V.posters(spark, sf).select("movieId", F.lit(True).alias("has_poster"))
    flagged = shelf.join(urls, "movieId", "left").withColumn("has_poster", F.coalesce("has_poster", F.lit(False)))
    position = ["list_no", "pos"]
    wall = lists.preferred_first(flagged, "has_poster", position).withColumn("view", F.lit("wall"))
    ring = lists.preferred_only_if_enough(flagged, "has_poster", position).withColumn("view", F.lit("ring"))
    return wall.unionByName(ring).select("view", "movieId", "title", "has_poster")


# --- scoring with given vectors -----------------------------------------------

@query
def score_pairs(spark, sf):
    pairs = recommend.rated_pairs(V.ratings(spark, sf))
    scored = scoring.score_pairs(pairs, V.user_factors(spark, sf), V.item_factors(spark, sf))
    return scored.withColumn("score", F.round("score", 6))


@query
def topk_per_user(spark, sf):
    top = scoring.top_k_per_user(V.user_factors(spark, sf), V.item_factors(spark, sf))
    return top.withColumn("score", F.round("score", 6))


@query
def exclude_rated(spark, sf):
    picks = recommend.exclude_rated(A.vector_top(spark, sf), V.ratings(spark, sf))
    return picks.withColumn("score", F.round("score", 6))


@query
def exclude_rated_clustered(spark, sf):
    """The same rows from tables clustered by user, without a shuffle."""
    picks = layout.exclude_rated(A.picks_by_user(spark, sf), A.ratings_by_user(spark, sf))
    return picks.select("userId", "rank", "movieId", F.round("score", 6).alias("score"))


@query
def rated_sets_clustered(spark, sf):
    return layout.rated_pairs(A.ratings_by_user(spark, sf))


@query
def user_counts_clustered(spark, sf):
    return layout.user_counts(A.ratings_by_user(spark, sf))


@query
def one_user_history(spark, sf):
    """One user's ratings: one bucket is read."""
    return layout.history(A.ratings_by_user(spark, sf), ONE_USER).select("userId", "movieId", "rating", "timestamp")


@query
def one_user_given(spark, sf):
    """One user's answer by given vectors, from clustered tables."""
    vectors = A.vectors_by_user(spark, sf, "given", lambda: V.user_factors(spark, sf))
    answer = recommend.answer_user(
        vectors, V.item_factors(spark, sf), A.ratings_by_user(spark, sf), A.titles_by_film(spark, sf), ONE_USER)
    return answer.withColumn("score", F.round("score", 6))


@query
def ranked_list(spark, sf):
    """Remaining picks, renumbered."""
    picks = A.vector_picks(spark, sf).select("userId", "movieId", "score")
    ranked = lists.number_rows(picks, "userId", F.desc("score"), F.asc("movieId"))
    return ranked.withColumn("score", F.round("score", 6))


@query
def pick_size_histogram(spark, sf):
    raters = A.vector_top(spark, sf).select("userId").distinct()
    return recommend.list_sizes(recommend.nested_picks(A.vector_picks(spark, sf), raters))


@query
def used_catalogue(spark, sf):
    movies = V.movies(spark, sf)
    popular = popularity.popular_list(V.ratings(spark, sf), movies)
    used = recommend.used_films(A.vector_picks(spark, sf), popular)
    return recommend.lookup_movies(movies, used)


@query
def genre_mix(spark, sf):
    picks = recommend.with_metadata(A.vector_picks(spark, sf), V.movies(spark, sf))
    return recommend.genre_mix(picks).withColumn("share", F.round("share", 6))


@query
def route_requests(spark, sf):
    movies = V.movies(spark, sf)
    return recommend.route(
        _customers(spark, sf), V.user_factors(spark, sf), A.vector_picks(spark, sf), movies,
        popularity.popular_array(V.ratings(spark, sf), movies),
    )


@query
def rmse_fixed(spark, sf):
    scored = scoring.score_pairs(V.ratings(spark, sf), V.user_factors(spark, sf), V.item_factors(spark, sf))
    return model.rmse(scored, prediction="score").withColumn("rmse", F.round("rmse", 6))


# --- trained model ------------------------------------------------------------

@query
def hash_split(spark, sf):
    train, test = model.hash_split(V.ratings(spark, sf))
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count_distinct("userId").alias("n_users")
    )


@query
def random_split(spark, sf):
    """Both parts together are the table, row for row."""
    ratings = A.ratings_table(spark, sf)
    train, test = model.random_split(ratings)
    parts = train.withColumn("part", F.lit(1)).unionByName(test.withColumn("part", F.lit(0)))
    keys = ["userId", "movieId", "rating", "timestamp"]
    in_parts = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("n_train"))
    return in_parts.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.hash(*keys).cast("bigint") * F.col("n")).alias("checksum"),
        F.sum("n_train").alias("n_train"),
    ).select(
        "n_rows",
        (F.col("checksum") == ratings.agg(F.sum(F.hash(*keys).cast("bigint"))).scalar()).alias("same_rows"),
        F.col("n_train").between(0.75 * F.col("n_rows"), 0.85 * F.col("n_rows")).alias("near_80_pct"),
    )


@query
def rmse_global_mean(spark, sf):
    train, test = model.hash_split(V.ratings(spark, sf))
    return model.global_mean_rmse(train, test).withColumn("rmse", F.round("rmse", 6))


@query
def als_train(spark, sf):
    return model.factor_summary(A.trained_model(spark, sf))


@query
def als_predict(spark, sf):
    _, test = model.hash_split(A.ratings_table(spark, sf))
    predicted = model.predict(A.trained_model(spark, sf), model.als_input(test))
    return predicted.agg(
        F.count(F.lit(1)).alias("n_predicted"),
        F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("n_undefined"),
        F.count_if(F.col("prediction") < 0).alias("n_negative"),
    )


@query
def als_grid(spark, sf):
    """Every setting's error, checked against one from the model's vectors, and the mark of the lowest."""
    train, test = model.hash_split(A.ratings_table(spark, sf))
    test = materialise(test, "grid-test")  # read twice for every setting
    models = model.tuned_models(train)
    again = reduce(DataFrame.unionByName, [
        model.rmse(scoring.score_pairs(test, m.userFactors, m.itemFactors), prediction="score").select(
            F.lit(n).alias("max_iter"), F.lit(r).alias("rank"), F.lit(reg).alias("reg_param"), F.col("rmse").alias("other"),
        ) for (r, reg, n), m in models
    ])
    checked = model.tune(models, test).join(again, ["rank", "reg_param", "max_iter"])
    lowest = F.min("other").over(Window.partitionBy())  # one row per setting
    return checked.select(
        "rank", "reg_param", "max_iter", "n_scored",
        (F.abs(F.col("rmse") - F.col("other")) < 1e-5 * F.col("other")).alias("error_agrees"),
        (F.col("is_best") == (F.col("other") == lowest)).alias("best_agrees"),
    )


@query
def factor_scan(spark, sf):
    path = A.model_path(spark, sf)
    sides = [(side, readers.read_factors(spark, f"{path}/{side}Factors")) for side in ("user", "item")]
    user, item = [f.select(F.lit(s).alias("side"), "id", F.size("features").alias("n")) for s, f in sides]
    return user.unionByName(item)


@query
def model_roundtrip(spark, sf):
    """Save, load, save again: counts and settings survive."""
    loaded = A.trained_model(spark, sf)
    path = scratch_path(spark, "als-copy")
    model.save(loaded, path)
    again = model.load(path)
    return model.factor_summary(again).select(
        "side", "n_factors", F.lit(again.rank).alias("rank"),
        F.lit(again.getOrDefault("coldStartStrategy")).alias("cold_start"),
    )


def _list_check(top, kept):
    """Per user: picks before exclusion, and how many were dropped."""
    before = top.groupBy("userId").agg(F.count(F.lit(1)).alias("n_top"), F.max("rank").alias("last_rank"))
    after = kept.groupBy("userId").agg(F.count(F.lit(1)).alias("n_kept"))
    return before.join(after, "userId", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


@query
def recommend_all(spark, sf):
    """Every user of the model: ten picks, those already rated removed."""
    ratings = A.ratings_table(spark, sf)
    top = A.model_top(spark, sf)
    kept = materialise(recommend.exclude_rated(top, ratings), "kept")  # counted and checked
    rated = recommend.rated_pairs(ratings).join(kept, ["userId", "movieId"], "left_semi")
    n_rated = rated.groupBy("userId").agg(F.count(F.lit(1)).alias("n_rated"))
    return _list_check(top, kept).join(n_rated, "userId", "left").select(
        "userId", "n_top", "last_rank", (F.col("n_kept") <= F.col("n_top")).alias("within_top"),
        F.coalesce("n_rated", F.lit(0)).alias("n_rated_kept"),
    )


@query
def recommend_users(spark, sf):
    """A table of users asks the trained model: rated films removed, ranked, titled, rounded.

    Unknown users get nothing here. What holds for any model is checked per user."""
    ratings = A.ratings_table(spark, sf)
    top = recommend.picks_from_model(A.trained_model(spark, sf), users=_customers(spark, sf))
    top = materialise(top, "users-top")  # counted below and answered from
    answered = materialise(recommend.answer_users(top, ratings, V.movies(spark, sf)), "answers")
    rated = recommend.rated_pairs(ratings)
    gone = top.join(rated, ["userId", "movieId"], "left_semi").groupBy("userId").agg(F.count(F.lit(1)).alias("n_gone"))
    left = answered.join(rated.withColumn("seen", F.lit(True)), ["userId", "movieId"], "left").groupBy("userId").agg(
        F.count(F.lit(1)).alias("n_left"), F.max("rank").alias("last_rank"), F.count("seen").alias("n_seen"),
        F.count_if(F.col("title").isNull()).alias("n_untitled"),
    )
    whole = top.groupBy("userId").agg(F.count(F.lit(1)).alias("n_top"))
    counted = whole.join(gone, "userId", "left").join(left, "userId", "left")
    n_left = F.coalesce("n_left", F.lit(0))
    return counted.select(
        "userId", "n_top", (n_left + F.coalesce("n_gone", F.lit(0)) == F.col("n_top")).alias("adds_up"),
        (F.coalesce("last_rank", F.lit(0)) == n_left).alias("ranks_in_a_row"),
        F.coalesce("n_seen", F.lit(0)).alias("n_seen"), F.coalesce("n_untitled", F.lit(0)).alias("n_untitled"),
    )


@query
def recommend_users_given(spark, sf):
    """The same chain with given vectors, so that every row can be checked."""
    users = V.user_factors(spark, sf).join(
        _customers(spark, sf).select(F.col("userId").alias("id")), "id", "left_semi")
    top = scoring.top_k_per_user(users, V.item_factors(spark, sf), counted=V.user_factors(spark, sf))
    return recommend.answer_users(top, V.ratings(spark, sf), V.movies(spark, sf))


def flagship(spark, sf):
    """Answer every customer: own picks from the trained model, else the popular list."""
    ratings, movies = V.ratings(spark, sf), V.movies(spark, sf)
    trained = A.trained_model(spark, sf)
    picks = recommend.exclude_rated(A.model_top(spark, sf), ratings)
    return recommend.route(
        _customers(spark, sf), trained.userFactors, picks, movies,
        popularity.popular_array(ratings, movies),
    )


# --- quality of lists ----------------------------------------------------------

def _train_free_lists(spark, sf):
    """Lists by given vectors without the films of the training part, numbered anew."""
    train, _ = model.hash_split(A.ratings_table(spark, sf))
    return ranking.renumbered(recommend.exclude_rated(A.vector_top(spark, sf), train))


@query
def ranking_per_user(spark, sf):
    """Precision, recall and discounted gain of each list against the held-out ratings."""
    _, test = model.hash_split(A.ratings_table(spark, sf))
    found = ranking.user_metrics(_train_free_lists(spark, sf), test)
    return found.select("userId", "n_relevant", "n_hits", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")))


@query
def ranking_summary(spark, sf):
    """Means over users, by how many stars make a film relevant."""
    _, test = model.hash_split(A.ratings_table(spark, sf))
    lists = materialise(_train_free_lists(spark, sf), "lists")
    return reduce(DataFrame.unionByName, [
        ranking.mean_metrics(ranking.user_metrics(lists, test, relevant_from=stars)).select(
            F.lit(stars).alias("relevant_from"), "n_users", "n_users_hit",
            *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")))
        for stars in (3, 4, 5)
    ])


@query
def novelty_per_list(spark, sf):
    """Mean surprise of each list by given vectors."""
    found = ranking.list_novelty(A.vector_picks(spark, sf), ranking.self_information(A.ratings_table(spark, sf)))
    return found.withColumn("novelty", F.round("novelty", 6))


@query
def film_self_information(spark, sf):
    return ranking.self_information(A.ratings_table(spark, sf)).withColumn("bits", F.round("bits", 6))


@query
def catalogue_exposure(spark, sf):
    """Share of the catalogue in the lists, and how unequally films are shown."""
    found = ranking.exposure(A.vector_picks(spark, sf), V.movies(spark, sf))
    return found.select("n_films", "n_shown", F.round("coverage", 6).alias("coverage"), "n_slots", F.round("gini", 6).alias("gini"))


# --- implicit feedback ----------------------------------------------------------

@query
def implicit_confidence(spark, sf):
    return implicit.confidence(implicit.counted(V.item_events(spark, sf)))


def _implicit_parts(spark, sf):
    counts = A.written(spark, sf, "event-counts", lambda: implicit.counted(V.item_events(spark, sf)))
    return model.hash_split(counts)


def _implicit_model(spark, sf):
    def make():
        path = scratch_path(spark, "implicit-model")
        model.save(implicit.train(_implicit_parts(spark, sf)[0]), path)
        return path

    return model.load(A._once(spark, sf, "implicit-model", make))


@query
def implicit_train(spark, sf):
    return model.factor_summary(_implicit_model(spark, sf))


@query
def implicit_compared(spark, sf):
    """Held-out items found by lists of the implicit model and by the most popular items: what holds for any model,
    and the baseline's figures as they are."""
    train, test = _implicit_parts(spark, sf)
    fitted = _implicit_model(spark, sf)
    lists = {"model": recommend.exclude_rated(recommend.picks_from_model(fitted, k=30), train)}
    popular = train.groupBy("movieId").agg(F.sum("rating").alias("score")).orderBy(F.desc("score"), "movieId").limit(30)
    users = train.select("userId").distinct()  # thirty rows are joined to each
    every = users.withColumn("found", popular.agg(F.collect_list(F.struct("movieId", "score"))).scalar())
    every = every.select("userId", F.inline("found"))
    lists["popular"] = recommend.exclude_rated(every, train)
    rows = []
    for name, picks in lists.items():
        per_user = ranking.user_metrics(ranking.renumbered(picks), test, relevant_from=1)
        mean = ranking.mean_metrics(per_user)
        exact = F.lit(name) == "popular"
        rows.append(mean.select(
            F.lit(name).alias("lists"), "n_users",
            *(F.when(exact, F.round(c, 6)).alias(c) for c in ("precision", "recall")),
            (F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("ndcg").between(0, 1)).alias("within_bounds"),
            (F.col("n_users_hit") > 0).alias("finds_some")))
    return reduce(DataFrame.unionByName, rows)


# --- newcomers ----------------------------------------------------------------

@query
def bayesian_average(spark, sf):
    return _scored_films(spark, sf).select("movieId", "cnt", "mean", F.round("score", 6).alias("score"))


@query
def rating_pool(spark, sf):
    return FO.rating_pool(_films(spark, sf), POOL_MIN).select("mood", "movieId", "cnt")


@query
def request_ratings(spark, sf):
    return foldin.rated_films(V.request_reactions(spark, sf), _films(spark, sf))


@query
def request_candidates(spark, sf):
    return foldin.candidate_counts(_prepared(spark, sf), _films(spark, sf), REACH)


@query
def anchor_ladder(spark, sf):
    found = foldin.anchors(_prepared(spark, sf), _scored_films(spark, sf), TIERS)
    return found.select("wanted", "era", "tier", F.inline("anchors")).select(
        "wanted", "era", "tier", "pos", "movieId"
    )


@query
def foldin_rows(spark, sf):
    rows = foldin.fold_in_rows(
        _prepared(spark, sf), _rated(spark, sf), _scored_films(spark, sf), tiers=TIERS
    )
    return rows.withColumn("w", F.round("w", 6))


@query
def gram_matrix(spark, sf):
    return foldin.gram_cells(_equations(spark, sf), fixed.RANK)


@query
def gram_rhs(spark, sf):
    return foldin.rhs_cells(_equations(spark, sf))


@query
def foldin_solve(spark, sf):
    """Per request: vector length, sign and whether the normal equations are met, relative to
    the right-hand side, on the coordinates that stayed."""
    solved = foldin.solve(_equations(spark, sf), fixed.RANK)
    k = fixed.RANK
    cell = {pair: i for i, pair in enumerate((a, c) for a in range(k) for c in range(a, k))}
    u = F.col("vector")
    gaps = []
    for a in range(k):
        row = " + ".join(f"gram[{cell[min(a, c), max(a, c)]}] * vector[{c}]" for c in range(k))
        gaps.append(f"IF(vector[{a}] > 0, abs({row} + ridge * vector[{a}] - rhs[{a}]), 0.0D)")
    return solved.select(
        "reqId",
        F.size(u).alias("n_values"),
        (F.array_min(u) >= 0).alias("non_negative"),
        F.expr(f"greatest({', '.join(gaps)}) <= 1e-10 * greatest(1.0D, array_max(rhs))").alias("solved"),
    )


@query
def genre_affinity(spark, sf):
    return foldin.request_affinity(_equations(spark, sf)).withColumn("affinity", F.round("affinity", 6))


@query
def genre_fit(spark, sf):
    pairs = A.reactions_table(spark, sf).select("reqId", "movieId")
    fit = foldin.genre_fit(_equations(spark, sf), pairs, _films(spark, sf))
    return fit.withColumn("fit", F.round("fit", 6))


@query
def mood_rank(spark, sf):
    """Ranking with given user vectors, so that every value can be checked."""
    users = V.user_factors(spark, sf).select(F.col("id").alias("reqId"), F.col("features").alias("vector"))
    vectors = _equations(spark, sf).join(users, "reqId")
    ranked = foldin.rank_for_requests(
        vectors, _films(spark, sf), _rated(spark, sf), reach=REACH, counted=users
    )
    return ranked.select(
        "reqId", "rank", "movieId", "predictedRating", F.round("rank_score", 6).alias("rank_score")
    )


@query
def mood_recommend(spark, sf):
    """End to end. Per request: list length, ranks, and films that break a filter."""
    requests, reactions = _requests(spark, sf), V.request_reactions(spark, sf)
    films = _scored_films(spark, sf)
    picks = foldin.recommend_for_requests(requests, reactions, films, reach=REACH, tiers=TIERS)
    prepared = _prepared(spark, sf)
    seen = _rated(spark, sf).select("reqId", "movieId", F.lit(True).alias("seen"))
    known = films.select("movieId", "mask", "year", "cnt")
    checked = picks.join(known, "movieId").join(prepared, "reqId").join(seen, ["reqId", "movieId"], "left")
    fits = (
        G.any_genre(F.col("mask"), F.col("wanted"))
        & F.col("year").between(R.range_end(F.col("era"), fixed.ERAS, 0), R.range_end(F.col("era"), fixed.ERAS, 1))
        & F.col("cnt").between(R.range_end(F.col("reach"), REACH, 0), R.range_end(F.col("reach"), REACH, 1))
        & F.col("seen").isNull()
    )
    return checked.groupBy("reqId").agg(
        F.count(F.lit(1)).alias("n_picks"),
        F.max("rank").alias("last_rank"),
        F.count_if(~fits).alias("n_wrong"),
    )
