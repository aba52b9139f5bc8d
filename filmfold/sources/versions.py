"""Tables that are replaced whole: written aside, then made current by one small file.

A table is a folder with ``data/``, a folder for each version, and ``log/``, a
one-row file for each finished version. Readers take the version that the log
names last, so they see the old rows until the new ones are whole, and go on
seeing them if a load fails. The log file is a single file, put in its place by
one rename when its writer commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from filmfold.session import delete

LOG = "number bigint, folder string, n_rows bigint, n_null map<string,bigint>, at timestamp"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).json(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Finished versions with their counts, the current one first."""
    return _log(spark, path).orderBy(F.desc("number"), F.desc("folder"))


def current(spark: SparkSession, path: str) -> Row | None:
    return history(spark, path).first()


def counts_of(columns: Iterable[str]) -> list[F.Column]:
    """The rows, and the nulls of each column, as aggregates to observe."""
    return [F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in columns)]


def refresh(df: DataFrame, path: str) -> Row:
    """Replace a table; returns the log's row, with the counts taken while writing.

    The rows are read once: counts are observed in the tasks that write, the last
    stage of the job, of which each task's success counts once.
    """
    spark, seen = df.sparkSession, Observation()
    before = current(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    df.observe(seen, *counts_of(df.columns)).write.parquet(f"{path}/{folder}")
    found = seen.get
    nulls = {c: found[f"null {c}"] for c in df.columns}
    number = before.number + 1 if before else 1
    entry = spark.createDataFrame([(number, folder, found["n_rows"], nulls)], "number bigint, folder string, n_rows bigint, n_null map<string,bigint>")
    entry.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/log")
    return current(spark, path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current version; a table that was never loaded is empty."""
    found = current(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{found.folder}") if found else spark.createDataFrame([], schema)


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last versions. One is kept for readers that began before the last load.

    The log has one row for each load since the last call, so it is read whole.
    """
    if current(spark, path) is None:
        return 0
    log = spark.read.schema(LOG).json(f"{path}/log").select("number", "folder", F.col("_metadata.file_path").alias("file"))
    old = log.orderBy(F.desc("number"), F.desc("folder")).collect()[keep:]
    for version in old:
        delete(spark, f"{path}/{version.folder}")
        delete(spark, version.file)
    return len(old)


def column_counts(entries: dict[str, Row], spark: SparkSession) -> DataFrame:
    """table_name, column_name, n_rows, n_null of loads, from their log rows: one row for each column, no table is read."""
    rows = [(name, column, entry.n_rows, n) for name, entry in entries.items() for column, n in entry.n_null.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, n_rows bigint, n_null bigint")
