"""File readers with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from filmfold import fixed, schemas
from filmfold.functions import genres as G, numbers as N

DAT_SEPARATOR = "::"
LATIN_1 = "ISO-8859-1"


def read_dat(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Headerless ``::``-separated file. Titles may hold quotes, so quoting is off."""
    return spark.read.csv(path, sep=DAT_SEPARATOR, schema=schema, encoding=encoding, quote="")


def read_dat_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_dat(spark, path, schemas.RATINGS)


def read_dat_movies(spark: SparkSession, path: str) -> DataFrame:
    return read_dat(spark, path, schemas.MOVIES, LATIN_1)


def read_dat_users(spark: SparkSession, path: str) -> DataFrame:
    return read_dat(spark, path, schemas.USERS, LATIN_1)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated file with a header row and doubled quotes."""
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Like :func:`read_csv`, but a missing path is an empty table."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Film to external id; films without one are left out."""
    return nonblank_links(read_optional_csv(spark, path, schemas.LINKS))


def nonblank_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("tmdbId").isNotNull() & (F.col("tmdbId") != ""))


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """Latent vectors as stored with a model."""
    return spark.read.schema(schemas.FACTORS).parquet(path)


def read_json_map(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """JSON objects of id to text as (movieId, url) rows: one object per line, or with ``whole`` one per file.

    A line that is not a JSON object adds no rows, but a file of which no line is
    one raises: it may be one object over several lines, which ``whole`` reads.
    A missing path is an empty table.
    """
    schema = T.StructType([
        T.StructField("movieId", T.LongType()), T.StructField("url", T.StringType()),
    ])
    try:
        lines = spark.read.text(path, wholetext=whole)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parsed = lines.select(F.from_json("value", "map<string,string>").alias("entry"))
    if not lines.filter("trim(value) <> ''").isEmpty() and parsed.filter("entry is not null").isEmpty():
        raise ValueError(f"no line of {path} is a JSON object; whole=True reads one object per file")
    entries = parsed.select(F.explode("entry").alias("k", "url"))
    return entries.select(F.expr("try_cast(k AS bigint)").alias("movieId"), "url").filter(
        F.col("movieId").isNotNull()
    )


def read_film_lines(spark: SparkSession, path: str) -> DataFrame:
    """Decode compact film lines ``[id,title,year,mask,count,mean10,f0..]``, with vectors as long as they are."""
    row = spark.read.text(path).select(F.from_json("value", "array<string>").alias("v"))
    v = F.col("v")
    quantised = F.transform(F.slice(v, 7, F.greatest(F.size(v) - 6, F.lit(0))), lambda x: x.cast("int"))
    mask = v[3].cast("int")
    return row.select(
        v[0].cast("bigint").alias("movieId"),
        v[1].alias("title"),
        v[2].cast("int").alias("year"),
        mask.alias("mask"),
        v[4].cast("int").alias("cnt"),
        (v[5].cast("int") / 10).alias("mean"),
        G.mask_genres(mask).alias("genres"),
        N.dequantise(quantised).alias("features"),
    )


def read_pick_table(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed picks keyed by user; a filter or join on userId prunes row groups."""
    return spark.read.schema("userId bigint, picks array<struct<movieId:bigint,score:double>>").parquet(path)


def rows_to_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """In-memory rows as a table; the schema is required, so no rows is fine too."""
    return spark.createDataFrame(rows, schema)
