import pytest
from pyspark.sql import functions as F

from filmfold.operators import lists, matching, model, popularity, profile, recommend, skew
from filmfold.session import scratch_path

RATINGS = "userId int, movieId int, rating int, timestamp long"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame(
        [(1, "One, The (1990)", "Drama|War"), (2, "Two (1991)", "War"), (4, "Four", "Comedy")],
        "movieId int, title string, genres string")


@pytest.fixture(scope="module")
def ratings(spark):
    """Film 3 is not in the catalogue; user 9 and film 2 hold most rows, with copies."""
    hot = [(9, 2, 5, 10)] * 400 + [(9, 3, 4, 11)] * 200
    return spark.createDataFrame(hot + [(1, 1, 3, 1), (1, 2, 4, 2), (2, 4, 1, 3)], RATINGS)


def test_popular_list_keeps_ranks_when_a_film_is_unknown(ratings, movies):
    assert _rows(popularity.popular_list(ratings, movies).select("rank", "movieId")) == [(1, 2), (3, 1), (4, 4)]


def test_exclusion_with_copies_of_a_hot_pair(spark, ratings):
    picks = spark.createDataFrame([(9, 1, 1, 5.0), (9, 2, 2, 4.0), (1, 1, 4, 3.0), (7, 1, 2, 2.0)],
                                  "userId int, rank int, movieId int, score double")
    kept = recommend.exclude_rated(picks, ratings)
    assert _rows(kept.select("userId", "movieId")) == [(1, 4), (7, 2), (9, 1)]


def test_routing(spark, ratings, movies):
    users = spark.createDataFrame([(1,), (9,), (99999,)], "userId int")
    factors = spark.createDataFrame([(1, [1.0]), (9, [1.0])], "id int, features array<double>")
    picks = spark.createDataFrame([(1, 1, 4, 5.755)], "userId int, rank int, movieId int, score double")
    answers = recommend.route(users, factors, picks, movies, popularity.popular_array(ratings, movies))
    got = _rows(answers.select("userId", "type", "rank", "movieId"))
    # user 9 is known but has nothing left; the unknown user gets the popular list
    assert got == [(1, "personalized", 1, 4), (99999, "popular", 1, 2), (99999, "popular", 3, 1), (99999, "popular", 4, 4)]


def test_nested_lists_keep_empty_users(spark):
    picks = spark.createDataFrame([(1, 2, 5, 4.126), (1, 1, 6, 4.5)], "userId int, rank int, movieId int, score double")
    users = spark.createDataFrame([(1,), (2,)], "userId int")
    nested = recommend.nested_picks(picks, users)
    rows = {r.userId: [(p.movieId, p.score) for p in r.picks] for r in nested.collect()}
    assert rows == {1: [(6, 4.5), (5, 4.13)], 2: []}
    assert _rows(recommend.list_sizes(nested)) == [(0, 1), (2, 1)]


def test_serving_uses_a_stand_in_title(spark, ratings, movies):
    table = spark.createDataFrame([(1, [(77, 4.5)]), (2, [])], "userId int, picks array<struct<movieId:int,score:double>>")
    users = spark.createDataFrame([(1,), (2,), (3,)], "userId int")
    served = recommend.serve(users, table, movies, popularity.popular_array(ratings, movies))
    own = served.filter("type = 'personalized'").select("userId", "title", "genres").collect()
    assert [tuple(r) for r in own] == [(1, "Movie 77", "")]
    assert served.filter("userId = 2").count() == 0 and served.filter("userId = 3").count() == 3


def test_request_ids(spark):
    raw = spark.createDataFrame([(" 42 ",), ("",), ("abc",), ("12345678",), ("1234567",), ("4.0",), (None,)], "raw_id string")
    good = {r.raw_id: r.userId for r in recommend.valid_requests(raw).filter("is_valid").collect()}
    assert good == {" 42 ": 42, "1234567": 1234567}


def test_normalised_rows(spark, movies):
    row = recommend.normalise_movies(movies.filter("movieId = 1").withColumn("posterUrl", F.lit(""))).first()
    assert (row.id, row.rawTitle, row.title, row.year) == (1, "One, The (1990)", "The One", 1990)
    assert row.genres == ["Drama", "War"] and row.predicted is None and row.posterUrl is None


def test_genre_shares_sum_to_one(spark, movies):
    picks = recommend.with_metadata(spark.createDataFrame([(1, 1), (1, 2)], "userId int, movieId int"), movies)
    assert _rows(recommend.genre_mix(picks)) == [(1, "Drama", 0.25), (1, "War", 0.75)]


def test_join_to_a_written_side(spark):
    many = spark.createDataFrame([(1, "same")] * 500 + [(2, "x"), (3, "y"), (None, "z")], "k int, v string")
    one = spark.createDataFrame([(1, "one"), (2, "two")], "k int, w string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(repr, skew.plain_join(many, one, ["k"], how).collect())) == sorted(
            map(repr, many.join(one, ["k"], how).collect()))


def test_a_hot_key_is_split_by_its_bytes(spark):
    """Two thirds of the rows have one key; no task joins a third of them."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        for n in (40_000, 80_000):
            spark.conf.set("spark.sql.shuffle.partitions", str(n // 2500))  # follows the input, as scale_settings has it
            many = spark.range(0, n, 1, n // 2500).select(
                F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).alias("k"), F.uuid().alias("v"))
            one = spark.range(n).select(F.col("id").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
            joined = skew.plain_join(many, one, ["k"]).withColumn("task", F.spark_partition_id())
            path = scratch_path(spark, "hot")
            joined.write.parquet(path)
            counts = [r["count"] for r in spark.read.parquet(path).groupBy("task").count().collect()]
            assert sum(counts) == n
            assert max(counts) < n / 3
    finally:
        for name in conf:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_history_of_repeated_users(spark, ratings):
    users = spark.createDataFrame([(1,)] * 50 + [(9,)], "userId int")
    assert recommend.user_history(ratings, users).count() == 602


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")] + [(2, 9, "z")] * 100, "id int, pos int, t string")
    assert _rows(lists.dedup_keep_first(df, "id", "pos")) == [(1, 1, "a"), (2, 5, "c")]


def test_poster_lists(spark):
    df = spark.createDataFrame([(i, i, i % 3 == 0) for i in range(30)], "id int, pos int, has boolean")
    wall = [r.id for r in lists.preferred_first(df, "has", ["pos"], 12).collect()]
    assert wall == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 1, 2]
    enough = lists.preferred_only_if_enough(df, "has", ["pos"], 10)
    short = lists.preferred_only_if_enough(df, "has", ["pos"], 11)
    assert [r.id for r in enough.collect()] == list(range(0, 30, 3)) and [r.id for r in short.collect()] == list(range(11))


def test_profile(spark, ratings, movies):
    assert profile.duplicate_rows(ratings).first().n_duplicates == 598
    assert profile.matrix_sparsity(ratings, movies).first().sparsity_pct == pytest.approx((1 - 603 / 9) * 100)
    nulls = profile.null_counts(spark.createDataFrame([(1, None), (None, None)], "a int, b int"), "t")
    assert _rows(nulls) == [("t", "a", 1), ("t", "b", 2)]
    shares = {r.rating: r for r in profile.rating_distribution(ratings).collect()}
    assert shares[5].is_mode and shares[1].pct_at_least == 100.0


def test_title_matching_order(spark):
    movies = spark.createDataFrame([
        (1, "Matrix, The (1999)"), (2, "Seven (Se7en) (1995)"), (3, "Lost (1980)"), (4, "Plain"), (5, "Gone (1990)"),
    ], "movieId int, title string")
    catalogue = spark.createDataFrame([
        (10, "the matrix", 2000, "/later"), (11, "The Matrix", 1998, "/earlier"), (12, "THE MATRIX", None, "/any"),
        (20, "Seven", None, "/name-any-year"), (21, "Se7en", 1995, "/alternate-this-year"), (22, "Seven", 1995, None),
        (40, "Plain", 1950, "/b"), (39, "Plain", 1960, "/a"), (50, "Gone", 1990, None),
    ], "ext_id int, name string, year int, poster_path string")
    got = {r.movieId: (r.poster_path, r.year_pos, r.name_pos) for r in matching.match_titles(movies, catalogue).collect()}
    assert got == {1: ("/earlier", 1, 0), 2: ("/alternate-this-year", 0, 1), 4: ("/a", 0, 0)}


def test_hot_name_does_not_multiply_rows(spark):
    movies = spark.range(300).select(F.col("id").cast("int").alias("movieId"), F.lit("Same (1990)").alias("title"))
    catalogue = spark.range(300).select(
        F.col("id").cast("int").alias("ext_id"), F.lit("same").alias("name"), F.lit(1990).alias("year"), F.lit("/p").alias("poster_path"))
    got = matching.match_titles(movies, catalogue)
    assert got.count() == 300 and got.filter("ext_id = 0").count() == 300


def test_poster_upsert_keeps_saved_and_rewrites_found(spark):
    movies = spark.createDataFrame([(1, "A (1990)"), (2, "B (1990)"), (3, "C (1990)")], "movieId int, title string")
    links = spark.createDataFrame([(2, "20"), (3, "")], "movieId int, tmdbId string")
    catalogue = spark.createDataFrame([(20, "zzz", 1990, "/b.jpg"), (10, "A", 1990, "/a.jpg")],
                                      "ext_id int, name string, year int, poster_path string")
    saved = spark.createDataFrame([(1, "http://kept/w500/a.jpg")], "movieId int, url string")
    merged = matching.upsert_posters(saved, movies, links, catalogue)
    assert _rows(merged) == [(1, "http://kept/w500/a.jpg"), (2, "https://images.example.org/t/p/w342/b.jpg")]
    assert _rows(matching.missing_posters(movies, merged)) == [(3, "C (1990)")]
    assert matching.match_coverage(movies, merged).first().coverage_pct == 66.7


def test_hash_split_does_not_depend_on_partitioning(spark, ratings):
    a, b = model.hash_split(ratings)
    c, _ = model.hash_split(ratings.repartition(5, "rating"))
    assert a.count() + b.count() == ratings.count() and _rows(a) == _rows(c)


def test_model_end_to_end(spark):
    rows = [(u, m, 1 + (u * m) % 5, 0) for u in range(30) for m in range(20) if (u + m) % 3]
    data = spark.createDataFrame(rows, RATINGS)
    fitted = model.train(data, max_iter=3)
    for r in model.factor_summary(fitted).collect():
        assert r.n_bad_length == 0 and r.n_negative == 0
    unknown = spark.createDataFrame([(999, 1, 3, 0)], RATINGS)
    assert model.predict(fitted, data.unionByName(unknown)).count() == len(rows)
    picks = recommend.picks_from_model(fitted, 5, spark.createDataFrame([(1,), (999,)], "userId int"))
    asked = picks.orderBy("rank").collect()
    everyone = recommend.picks_from_model(fitted, 5).filter("userId = 1").orderBy("rank").collect()
    alone = recommend.picks_for_user(fitted.userFactors, fitted.itemFactors, 1, 5).collect()
    assert [r.movieId for r in everyone] == [r.movieId for r in alone]
    assert [r.score for r in everyone] == pytest.approx([r.score for r in alone])
    assert [r.score for r in everyone] == pytest.approx([r.score for r in asked], rel=1e-5)
    films = [r.movieId for r in alone]
    assert recommend.picks_for_user(fitted.userFactors, fitted.itemFactors, 999).count() == 0
    movies = spark.createDataFrame([(films[1], "T", "War")], "movieId int, title string, genres string")
    seen = spark.createDataFrame([(1, films[0], 5, 0)] * 3, RATINGS)
    answer = recommend.recommend_user(fitted.userFactors, fitted.itemFactors, seen, movies, 1, 5).collect()
    assert [r.movieId for r in answer] == films[1:] and answer[0].title == "T" and answer[1].title is None
    got = picks.orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and {r.userId for r in got} == {1}
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_tuning_marks_one_best(spark):
    rows = [(u, m, 1 + (u * m) % 5, 0) for u in range(30) for m in range(20) if (u + m) % 3]
    train, test = model.hash_split(spark.createDataFrame(rows, RATINGS))
    tuned = model.tune(model.tuned_models(train, [(4, 0.1, 2), (6, 0.1, 2)]), test).collect()
    assert [r.is_best for r in tuned].count(True) == 1
    assert min(tuned, key=lambda r: r.rmse).is_best
