"""Tables clustered by user: plans without exchanges, one bucket for one user, users with very many rows, reopening."""

import random

import pytest
from pyspark.sql import functions as F

from filmfold.operators import recommend
from filmfold.session import scratch_path
from filmfold.sources import layout

RATINGS = "userId long, movieId long, rating int, timestamp long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on user 7, some without a user, some repeated."""
    rng = random.Random(4)
    rows = [(7 if rng.random() < 0.34 else rng.randrange(1, 60), rng.randrange(400), rng.randrange(1, 6), i) for i in range(6000)]
    rows += rows[:50] + [(None, 3, 4, 1), (None, 3, 4, 1)]
    ratings = spark.createDataFrame(rows, RATINGS)
    picks = spark.createDataFrame(
        [(u, r + 1, rng.randrange(400), 5.0 - r) for u in range(0, 64) for r in range(10)] + [(None, 1, 3, 1.0)],
        "userId long, rank int, movieId long, score double")
    table = layout.cluster(ratings, bucket_rows=1000)
    return ratings, picks, table, layout.cluster(picks, like=table)


def test_users_with_many_rows_lie_apart(spark, skewed):
    ratings, _, table, picks = skewed
    assert [r.userId for r in table.hot_users.collect()] == [7] and table.any_hot
    assert {r.userId for r in table.hot.select("userId").distinct().collect()} == {7}
    assert _rows(table.most.unionByName(table.hot)) == _rows(ratings)
    assert picks.buckets == table.buckets and picks.hot.count() == 10


def test_exclusion_has_no_exchange(spark, skewed):
    ratings, plain, table, picks = skewed
    with layout.by_part_of_the_key(spark):
        plan = _plan(layout.unrated(picks, table))
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("ShuffledHashJoin") == 4
    columns = ["userId", "rank", "movieId", "score"]
    assert _rows(layout.exclude_rated(picks, table), *columns) == _rows(recommend.exclude_rated(plain, ratings), *columns)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_other_buckets_are_refused(spark, skewed):
    _, plain, table, _ = skewed
    other = layout.cluster(plain, bucket_rows=10)
    with pytest.raises(ValueError, match="buckets"):
        layout.exclude_rated(other, table)


def test_pairs_and_counts_by_user(spark, skewed):
    ratings, _, table, _ = skewed
    assert "Exchange" not in _plan(layout.rated_pairs(table))
    assert "Exchange" not in _plan(table.most.groupBy("userId").count())
    assert _rows(layout.rated_pairs(table)) == _rows(ratings.select("userId", "movieId").distinct())
    assert _rows(layout.user_counts(table)) == _rows(ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("n")))


@pytest.mark.parametrize("user_id", [7, 8, 999])
def test_one_user_is_one_bucket(spark, skewed, user_id):
    ratings, _, table, _ = skewed
    found = layout.history(table, user_id)
    assert _rows(found) == _rows(ratings.filter(F.col("userId") == user_id))
    assert table.most.filter(f"userId = {user_id}").rdd.getNumPartitions() == 1 < table.most.rdd.getNumPartitions()
    key, before = "spark.sql.sources.bucketing.autoBucketedScan.enabled", "true"
    spark.conf.set(key, "false")
    try:
        plan = table.most.filter(f"userId = {user_id}")._jdf.queryExecution().toString()
    finally:
        spark.conf.set(key, before)
    assert f"SelectedBucketsCount: 1 out of {table.buckets}" in plan and "PushedFilters: [IsNotNull(userId), EqualTo(userId" in plan


def test_reopened_table(spark, skewed):
    ratings, _, table, _ = skewed
    again = layout.open_table(spark, table.path)
    assert again.buckets == table.buckets and again.any_hot
    assert again.most.columns == again.hot.columns == ratings.columns
    assert _rows(again.most.unionByName(again.hot)) == _rows(ratings)
    assert again.most.filter("userId = 8").rdd.getNumPartitions() == 1


def test_no_rows(spark):
    table = layout.cluster(spark.createDataFrame([], RATINGS))
    assert layout.rated_pairs(table).count() == 0 and layout.history(table, 1).count() == 0 and not table.any_hot


def test_answer_of_one_user(spark, skewed):
    ratings, _, table, _ = skewed
    rng = random.Random(9)
    vectors = [(i, [rng.random() for _ in range(3)]) for i in range(64)]
    items = spark.createDataFrame([(i, [round(rng.random(), 1) for _ in range(3)]) for i in range(400)] + [(400, None)],
                                  "id long, features array<float>")
    users = spark.createDataFrame(vectors, "id long, features array<float>")
    movies = spark.createDataFrame([(i, f"Film {i}", "Drama") for i in range(0, 400, 2)], "movieId long, title string, genres string")
    clustered = layout.bucketed(users.withColumnRenamed("id", "userId"), scratch_path(spark, "vectors"), "userId", 4, ["userId"])
    columns = ["userId", "movieId", "score", "title", "genres"]
    for user_id in (7, 8, 40):
        got = recommend.answer_user(clustered, items, table, movies, user_id)
        expected = recommend.recommend_user(users, items, ratings, movies, user_id)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in expected.select(*columns).collect()]
    nobody = recommend.answer_user(clustered, items, table, movies, 12345)
    assert nobody.columns == columns and nobody.count() == 0
