"""Readers that keep what they cannot read: every line is a row of the table or a reject (file, line, reason)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from filmfold import schemas
from filmfold.sources.readers import DAT_SEPARATOR, LATIN_1

#: A separator that stands in no line, so that the CSV reader, which knows character sets, gives whole lines.
NO_SEPARATOR = "\u0001\u0002\u0003\u0001"


class Checked(NamedTuple):
    """Lines with their columns and, where they were not accepted, the reason. Both parts come from one parse, so
    write ``rows`` first where both are needed."""

    rows: DataFrame
    columns: list[str]

    def good(self) -> DataFrame:
        return self.rows.filter("reason IS NULL").select(*self.columns)

    def rejects(self) -> DataFrame:
        return self.rows.filter("reason IS NOT NULL").select("file", "line", "reason")


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """file, line of every line that is not blank; with ``header``, all but the first of each file."""
    raw = spark.read.csv(path, schema="line string", sep=NO_SEPARATOR, quote="", encoding=encoding, header=header,
                         enforceSchema=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), "line").filter("trim(line) <> ''")


def _first(*reasons: Column) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def checked_fields(found: DataFrame, schema: T.StructType, required: Sequence[str], **options: str) -> Checked:
    """Lines (file, line) as rows of a schema.

    Fields are cut as text and then cast, so the reason names the first of: too
    few or too many fields, a value that is not of its type, a required value
    that is missing. Spaces around a number are accepted. No line is skipped and
    no value turns into null without a word.
    """
    names = [f"f{i}" for i in range(len(schema))]
    text = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("bad", T.StringType())])
    cut = F.from_csv("line", ", ".join(f"{f.name} string" for f in text), options | {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    cast, wrong, missing = [], [], []
    for name, field in zip(names, schema):
        kind, value = field.dataType.simpleString(), F.col(f"cut.{name}")
        cast.append(F.expr(f"try_cast(cut.{name} AS {kind})").alias(field.name))
        wrong.append(F.when(value.isNotNull() & F.expr(f"try_cast(cut.{name} AS {kind})").isNull(),
                            F.concat(F.lit(f"{field.name}: '"), value, F.lit(f"' is no {kind}"))))
        if field.name in required:
            missing.append(F.when(value.isNull(), F.lit(f"{field.name} is missing")))
    count = F.when(F.col("cut.bad").isNotNull(), F.lit(f"not {len(schema)} fields"))
    return Checked(found.withColumn("cut", cut).select("file", "line", _first(count, *wrong, *missing).alias("reason"), *cast),
                   schema.fieldNames())


def read_dat(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], encoding: str = "UTF-8") -> Checked:
    """Headerless ``::``-separated file; quotes are characters like others."""
    return checked_fields(lines(spark, path, encoding), schema, required, sep=DAT_SEPARATOR, quote="")


def read_dat_ratings(spark: SparkSession, path: str) -> Checked:
    return read_dat(spark, path, schemas.RATINGS, ["userId", "movieId", "rating"])


def read_dat_movies(spark: SparkSession, path: str) -> Checked:
    return read_dat(spark, path, schemas.MOVIES, ["movieId", "title"], LATIN_1)


def read_dat_users(spark: SparkSession, path: str) -> Checked:
    return read_dat(spark, path, schemas.USERS, ["userId"], LATIN_1)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str]) -> Checked:
    """Comma-separated file with a header row and doubled quotes."""
    return checked_fields(lines(spark, path, header=True), schema, required, sep=",", escape='"')


def read_json_map(spark: SparkSession, path: str) -> Checked:
    """JSON objects of id to text, one a line, as (movieId, url). A line that is no object is one reject, and so is each
    entry whose key is no id; an object without entries is neither. No job runs before the rows are asked for."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = raw.filter("trim(line) <> ''").withColumn("entry", F.from_json("line", "map<string,string>"))
    no_object = F.create_map(F.lit(""), F.lit(None).cast("string"))  # one row for such a line
    entries = parsed.withColumn("is_object", F.col("entry").isNotNull()).select(
        "file", "line", "is_object", F.explode(F.coalesce("entry", no_object)).alias("k", "url"))
    number = F.expr("try_cast(k AS bigint)")
    reason = F.when(~F.col("is_object"), F.lit("not a JSON object")).when(
        number.isNull(), F.concat(F.lit("key '"), F.col("k"), F.lit("' is no film id")))
    rows = entries.select("file", "line", reason.alias("reason"), F.when(reason.isNull(), number).alias("movieId"), "url")
    return Checked(rows, ["movieId", "url"])
