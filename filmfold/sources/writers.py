"""Sinks. Every one overwrites its target whole and writes in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmfold.sources.readers import DAT_SEPARATOR


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_dat(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Headerless ``::``-separated lines in the given encoding."""
    line = F.concat_ws(DAT_SEPARATOR, *[F.col(c).cast("string") for c in df.columns])
    # one column per line: the separator is a character that never occurs in a line
    df.select(line.alias("line")).write.mode("overwrite").csv(
        path, sep="\u0001", quote="", encoding=encoding
    )


def film_line(*, title: str = "title", features: str = "q") -> F.Column:
    """Compact JSON array of one film; numbers stay bare, the title is escaped."""
    quoted = F.to_json(F.array(F.col(title)))
    return F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            F.col("movieId").cast("string"),
            F.substring(quoted, F.lit(2), F.length(quoted) - 2),
            F.col("year").cast("string"),
            F.col("mask").cast("string"),
            F.col("cnt").cast("string"),
            F.col("mean10").cast("string"),
            F.array_join(F.col(features).cast("array<string>"), ","),
        ),
        F.lit("]"),
    )


def write_film_lines(films: DataFrame, path: str) -> None:
    """Film table as text, most-rated first: files in order, lines in order."""
    ordered = films.orderBy(F.desc("cnt"), "movieId")
    ordered.select(film_line().alias("value")).write.mode("overwrite").text(path)


def write_pick_table(picks: DataFrame, path: str) -> None:
    """Picks clustered by user, so that serving one user touches one row group."""
    (
        picks.repartitionByRange("userId")
        .sortWithinPartitions("userId")
        .write.mode("overwrite")
        .parquet(path)
    )


def write_pick_lines(picks: DataFrame, path: str) -> None:
    """The same picks as one JSON document per user, with the day of the run."""
    picks = picks.withColumn("generated", F.current_date())
    picks.select(F.to_json(F.struct(*picks.columns)).alias("value")).write.mode("overwrite").text(path)


def write_json_map(df: DataFrame, path: str, key: str = "movieId", value: str = "url") -> None:
    """Id-to-text map as JSON objects of one entry each, one per line.

    One object for the whole map would have to pass through a single task.
    """
    entry = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)))
    df.select(entry.alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated lines, in the order of the first column."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    df.orderBy(df.columns[0]).select(line.alias("value")).write.mode("overwrite").text(path)
