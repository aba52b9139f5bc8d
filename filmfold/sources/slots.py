"""A map of film to text in slots of ids: an upsert rewrites the slots that it touches and no others."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from filmfold.session import materialise

#: Film ids of one slot; a slot is a folder.
SLOT_FILMS = 1000
SCHEMA = "movieId bigint, url string, slot bigint"


def _with_slot(rows: DataFrame, slot_films: int) -> DataFrame:
    return rows.select("movieId", "url", F.expr(f"movieId div {slot_films}").alias("slot"))


def _write(rows: DataFrame, path: str) -> None:
    """Replace the slots that the rows lie in. Rows of one slot come together, so a slot is one file or, beyond the
    advised size of a partition, several."""
    rows.hint("rebalance", F.col("slot")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("slot").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """movieId, url, slot. A filter on slot reads its folder only. A missing path is an empty map."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def upsert(new: DataFrame, path: str, slot_films: int = SLOT_FILMS) -> int:
    """Add entries (movieId, url) for films that have none yet, and return how many slots were rewritten.

    Saved entries never change. Of several new entries for a film the least url
    is taken; those without film or url are left out. Touched slots are read,
    merged and written aside before any is replaced, so a failure while merging
    changes nothing. Their numbers pass through the driver, which holds the list
    of a table's folders in any case.
    """
    spark = new.sparkSession
    wanted = new.filter("movieId IS NOT NULL AND url IS NOT NULL").groupBy("movieId").agg(F.min("url").alias("url"))
    wanted = materialise(_with_slot(wanted, slot_films), "slot-entries")
    saved = read(spark, path)
    slots = [r.slot for r in wanted.select("slot").distinct().collect()]
    here = saved.filter(F.col("slot").isin(slots)) if slots else saved.limit(0)
    added = materialise(wanted.join(here.select("movieId"), "movieId", "left_anti").select("movieId", "url", "slot"), "slot-added")
    slots = [r.slot for r in added.select("slot").distinct().collect()]
    if not slots:
        return 0
    merged = saved.filter(F.col("slot").isin(slots)).select("movieId", "url", "slot").unionByName(added)
    _write(materialise(merged, "slot-merged"), path)
    return len(slots)
