"""Ratings-shaped views over the given star-schema tables.

Each view is a lazy DataFrame; ids are cast to int once, here, so that no
later join hides a cast. The SQL twins live in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmfold import fixed, schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per order line: who ordered, which part, stars from the quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("bigint").alias("userId"),
        F.col("l_partkey").cast("bigint").alias("movieId"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("rating"),
        _epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue with titles in the filed form: article last, alternates, year."""
    key = F.col("p_partkey")
    first, second = _pick(fixed.GENRES, key % 18), _pick(fixed.GENRES, F.col("p_size") % 18)
    title = F.concat(
        F.initcap("p_name"),
        F.when(key % 4 == 0, F.lit(", The")).otherwise(F.lit("")),
        F.when(key % 11 == 0, F.lit(" (Alt Name)")).otherwise(F.lit("")),
        F.when(key % 97 == 0, F.lit("")).otherwise(
            F.concat(F.lit(" ("), (1930 + key % 71).cast("string"), F.lit(")"))
        ),
    )
    return table(spark, sf_dir, "part").select(
        key.cast("bigint").alias("movieId"),
        title.alias("title"),
        F.array_join(F.array_distinct(F.array(first, second)), "|").alias("genres"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("bigint").alias("userId"),
        F.when(key % 2 == 1, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        _pick(list(fixed.AGE_LABELS), F.col("c_nationkey") % 7).alias("age"),
        (key % 21).cast("int").alias("occupation"),
        F.lpad(key.cast("string"), 5, "0").alias("zip"),
    )


def _factors(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    part = F.slice("embedding", first, fixed.RANK)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.transform(part, lambda x: F.abs(x.cast("double"))).alias("features"),
    )


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative film vectors given by the data, independent of any training."""
    return _factors(spark, sf_dir, 1)


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(spark, sf_dir, 11)


def posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved poster addresses; only part of the catalogue has one."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("bigint").alias("movieId"), "url"
    )


def external_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second catalogue to match against: clean names, years off by up to one or
    unknown. Some rows have no poster path, and hot things have one only under
    their alternate name, so some titles match late and some never."""
    key = F.col("p_partkey")
    shift = _pick([0, -1, 1, None], key % 4)
    hot, alternate = F.col("p_name").startswith("hot "), key % 11 == 0
    return table(spark, sf_dir, "part").select(
        (key + 100000).cast("bigint").alias("ext_id"),
        F.when(hot & alternate, F.lit("ALT NAME"))
        .when(key % 4 == 0, F.concat(F.lit("The "), F.initcap("p_name")))
        .otherwise(F.initcap("p_name"))
        .alias("name"),
        (1930 + key % 71 + shift).cast("int").alias("year"),
        F.when((F.col("p_size") % 5 == 0) | (hot & ~alternate), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/"), key.cast("string"), F.lit(".jpg")))
        .alias("poster_path"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Film to external id, blank or missing for many films."""
    size = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("movieId"),
        F.when(size == 0, F.lit(""))
        .when(size == 1, F.lit(None).cast("string"))
        .otherwise((F.col("p_partkey") + 100000).cast("string"))
        .alias("tmdbId"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference request per customer; some moods, eras and reaches unknown."""
    key = F.col("c_custkey")
    mood = _pick([*fixed.MOODS, None], key % 7)
    return table(spark, sf_dir, "customer").select(
        key.cast("bigint").alias("reqId"),
        mood.alias("mood"),
        _pick([*fixed.ERAS, "lost"], F.col("c_nationkey") % 5).alias("era"),
        _pick([*fixed.REACH, "mixed"], key % 4).alias("reach"),
    )


def request_reactions(spark: SparkSession, sf_dir: str, rated: DataFrame | None = None) -> DataFrame:
    """Reactions sent with the requests, in long form: each user's latest rating
    of every film they rated. Three stars and one star carry no known reaction.
    ``rated`` may be the ratings as a written table."""
    rated = ratings(spark, sf_dir) if rated is None else rated
    # time and stars in one number: a plain long keeps the aggregation hash-based
    latest = (
        rated.groupBy("userId", "movieId")
        .agg(F.max(F.col("timestamp") * 10 + F.col("rating")).alias("latest"))
    )
    stars = F.pmod(F.col("latest"), F.lit(10))
    return latest.select(
        F.col("userId").alias("reqId"),
        "movieId",
        F.when(stars == 5, F.lit("loved"))
        .when(stars == 4, F.lit("liked"))
        .when(stars == 2, F.lit("nope"))
        .otherwise(F.lit("seen"))
        .alias("reaction"),
    )


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did with an item, whose number stands in the event's properties."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("userId"),
        F.get_json_object("props", "$.k").cast("bigint").alias("movieId"), "event_type",
    )
