"""Tables clustered by user: a user is one bucket, and work by user needs no shuffle.

A bucketed table keeps the hash of its key in its layout. An equality filter on
the key reads one bucket, whose files are sorted, so it skips row groups too;
grouping by the key, or joining two tables of as many buckets, needs no
exchange. A user with more rows than a bucket should hold would make one task
long, so the rows of such users lie apart, a folder for each, bucketed by film.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmfold.session import materialise, scratch_path

#: Rows of one bucket, read by one task; a user with more of them is kept apart.
BUCKET_ROWS = 2_000_000
#: Bytes of a row group: what a filter on the sorted key reads at least.
GROUP_BYTES = 8 << 20

KEYS = ["userId", "movieId"]


class UserTable(NamedTuple):
    """Rows with userId and movieId: those of most users, those of users with very many, and the ids of these."""

    most: DataFrame
    hot: DataFrame
    hot_users: DataFrame
    buckets: int
    path: str
    any_hot: bool


def bucket_count(spark: SparkSession, rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """As many buckets as the rows need, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // bucket_rows))


def bucketed(df: DataFrame, path: str, key: str, buckets: int, sort: list[str], partition: str | None = None) -> DataFrame:
    """Write a table in buckets of one column, sorted inside, and read it as such."""
    spark, name = df.sparkSession, f"clustered_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *[c for c in (partition, key) if c])
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(*sort).option("path", path) \
        .option("parquet.block.size", GROUP_BYTES)
    if partition:
        writer = writer.partitionBy(partition)
    writer.saveAsTable(name)
    return spark.table(name)


def opened(spark: SparkSession, path: str, schema: str, key: str, buckets: int, sort: list[str], partition: str | None = None) -> DataFrame:
    """A table that :func:`bucketed` wrote, in another session or application. ``schema`` has its columns as DDL."""
    name = f"clustered_{uuid.uuid4().hex}"
    folders = f"PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet {folders} CLUSTERED BY ({key}) SORTED BY ({', '.join(sort)}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    if partition:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def cluster(rows: DataFrame, path: str | None = None, bucket_rows: int = BUCKET_ROWS, like: UserTable | None = None) -> UserTable:
    """Write rows clustered by user. ``like`` gives buckets and users kept apart of a table to be joined with.

    Rows are counted by user first, with a partial sum in every task. At most one
    user for each ``bucket_rows`` rows is kept apart, so their ids are few. Rows
    without a user lie in one bucket of the common table.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "by-user")
    if like:
        buckets, hot_users = like.buckets, like.hot_users
    else:
        counts = materialise(rows.groupBy("userId").agg(F.count(F.lit(1)).alias("n")), "user-counts")
        buckets = bucket_count(spark, counts.agg(F.sum("n")).first()[0] or 0, bucket_rows)
        hot_users = materialise(counts.filter((F.col("n") > bucket_rows) & F.col("userId").isNotNull()).select("userId"), "hot-users")
    most = rows.join(hot_users, "userId", "left_anti")
    hot = rows.join(hot_users, "userId", "left_semi")
    any_hot = not hot_users.isEmpty()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    note = spark.createDataFrame([(buckets, any_hot, ddl)], "buckets int, any_hot boolean, ddl string")
    out = UserTable(
        bucketed(most, f"{path}/most", "userId", buckets, KEYS),
        bucketed(hot, f"{path}/hot", "movieId", buckets, ["movieId"], "userId").select(rows.columns),
        hot_users, buckets, path, any_hot)
    hot_users.write.parquet(f"{path}/hot_users")
    note.write.json(f"{path}/note")  # last, so that a folder with a note is whole
    return out


def open_table(spark: SparkSession, path: str) -> UserTable:
    """What :func:`cluster` wrote to a folder."""
    note = spark.read.schema("buckets int, any_hot boolean, ddl string").json(f"{path}/note").first()
    columns = spark.createDataFrame([], note.ddl).columns
    return UserTable(
        opened(spark, f"{path}/most", note.ddl, "userId", note.buckets, KEYS),
        opened(spark, f"{path}/hot", note.ddl, "movieId", note.buckets, ["movieId"], "userId").select(columns),
        spark.read.schema("userId bigint").parquet(f"{path}/hot_users"), note.buckets, path, note.any_hot)


def history(table: UserTable, user_id: int) -> DataFrame:
    """One user's rows: one bucket of the common table, one folder of the other, row groups by the sorted key."""
    mine = f"userId = {int(user_id)}"
    found = table.most.filter(mine)
    return found.unionByName(table.hot.filter(mine)) if table.any_hot else found


def rated_pairs(table: UserTable) -> DataFrame:
    """Distinct (userId, movieId) without a shuffle: equal pairs share a bucket."""
    return table.most.select(*KEYS).distinct().unionByName(table.hot.select(*KEYS).distinct())


def user_counts(table: UserTable) -> DataFrame:
    """Rows of each user; only those of users kept apart are shuffled, as one row for each task."""
    def counts(df: DataFrame) -> DataFrame:
        return df.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))

    return counts(table.most).unionByName(counts(table.hot))


@contextmanager
def by_part_of_the_key(spark: SparkSession) -> Iterator[None]:
    """Let a join on user and film use tables that are clustered by one of the two."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unrated(picks: UserTable, ratings: UserTable) -> DataFrame:
    """Picks whose film the user has not rated; plan it inside :func:`by_part_of_the_key`.

    Bucket meets bucket: a bucket's picks are the hash table, at most ten or so
    for each of its users, and its ratings stream past them unsorted.
    """
    def left(some: DataFrame, rated: DataFrame) -> DataFrame:
        seen = rated.select(*KEYS).join(some.select(*KEYS).hint("shuffle_hash"), KEYS, "left_semi")
        return some.join(seen.hint("shuffle_hash"), KEYS, "left_anti")

    return left(picks.most, ratings.most).unionByName(left(picks.hot, ratings.hot))


def exclude_rated(picks: UserTable, ratings: UserTable) -> DataFrame:
    """The picks of :func:`unrated`, written; neither ratings nor picks are shuffled."""
    if picks.buckets != ratings.buckets:
        raise ValueError(f"{picks.buckets} and {ratings.buckets} buckets: cluster the picks like the ratings")
    with by_part_of_the_key(picks.most.sparkSession):
        return materialise(unrated(picks, ratings), "unrated")
