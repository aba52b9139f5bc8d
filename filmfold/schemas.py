"""Explicit schemas: nothing is inferred, so no extra scan and zip stays text."""

from pyspark.sql import types as T

GIVEN = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double",
    "part": "p_partkey bigint, p_name string, p_size int",
    "embeddings": "vec_id bigint, embedding array<float>",
    "pages": "page_id bigint, url string",
    "events": "user_id bigint, event_type string, props string",
}

RATINGS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
])

MOVIES = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

USERS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("occupation", T.IntegerType()),
    T.StructField("zip", T.StringType()),
])

FACTORS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
])

LINKS = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("tmdbId", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("reqId", T.LongType()),
    T.StructField("genres", T.ArrayType(T.StringType())),
    T.StructField("era", T.StringType()),
    T.StructField("reach", T.StringType()),
    T.StructField("ratings", T.MapType(T.LongType(), T.StringType())),
])
