"""Matching catalogue titles to an external catalogue, and the poster map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmfold import fixed
from filmfold.functions import titles as T
from filmfold.operators.skew import plain_join
from filmfold.sources.readers import nonblank_links

IMAGE_BASE = "https://images.example.org/t/p/w500"


def poster_url(path: Column, base: str = IMAGE_BASE) -> Column:
    return F.concat(F.lit(base), path)


def saved_size(url: Column) -> Column:
    """Address of the smaller image that is kept."""
    return F.replace(url, F.lit(fixed.FOUND_SIZE), F.lit(fixed.SAVED_SIZE))


def name_index(catalogue: DataFrame) -> DataFrame:
    """One row per lower-cased name: the first usable entry over all years and per
    year. Entries without a poster never win. However many entries share a name,
    it holds one value per release year, so matching never multiplies rows."""
    usable = catalogue.filter(F.col("poster_path").isNotNull()).select(
        F.lower("name").alias("name_key"), "year", F.struct("ext_id", "poster_path").alias("entry")
    )
    per_year = usable.groupBy("name_key", "year").agg(F.min("entry").alias("entry"))
    return per_year.groupBy("name_key").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "entry")))
        ).alias("by_year"),
        F.min("entry").alias("any_year"),
    )


def match_titles(movies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """External entry of each title: the first hit trying years in order (stated,
    one before, one after, any) and, within a year, the names in order."""
    tries = movies.select(
        "movieId",
        T.search_years(F.col("title")).alias("years"),
        F.posexplode(T.search_names(F.col("title"))).alias("name_pos", "name"),
    ).withColumn("name_key", F.lower("name"))
    found = plain_join(tries, name_index(catalogue), ["name_key"])
    hits = F.transform(
        F.col("years"),
        lambda year, pos: F.struct(
            pos.alias("year_pos"),
            F.col("name_pos").alias("name_pos"),
            F.when(year.isNull(), F.col("any_year"))
            .otherwise(F.try_element_at(F.col("by_year"), year))
            .alias("entry"),
        ),
    )
    best_here = F.array_min(F.filter(hits, lambda h: h["entry"].isNotNull()))
    return (
        found.select("movieId", best_here.alias("hit"))
        .groupBy("movieId")
        .agg(F.min("hit").alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(
            "movieId",
            F.col("hit.entry.ext_id").alias("ext_id"),
            F.col("hit.entry.poster_path").alias("poster_path"),
            F.col("hit.year_pos").alias("year_pos"),
            F.col("hit.name_pos").alias("name_pos"),
        )
    )


def linked_paths(links: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Poster paths found through a known external id."""
    ids = nonblank_links(links).select("movieId", F.expr("try_cast(tmdbId AS bigint)").alias("ext_id"))
    usable = catalogue.filter(F.col("poster_path").isNotNull()).select(
        "ext_id", F.col("poster_path").alias("linked_path")
    )
    return ids.join(usable, "ext_id").select("movieId", "linked_path")


def resolve_posters(
    movies: DataFrame, links: DataFrame, catalogue: DataFrame, base: str = IMAGE_BASE
) -> DataFrame:
    """Address per film: by known id, else by title; films without any stay, with null."""
    linked = movies.join(linked_paths(links, catalogue), "movieId", "left")
    open_films = linked.filter(F.col("linked_path").isNull()).select("movieId", "title")
    matched = match_titles(open_films, catalogue).select("movieId", F.col("poster_path").alias("found_path"))
    return linked.join(matched, "movieId", "left").select(
        "movieId",
        "title",
        F.when(F.col("linked_path").isNotNull(), F.lit("id"))
        .when(F.col("found_path").isNotNull(), F.lit("title"))
        .alias("matched_by"),
        poster_url(F.coalesce("linked_path", "found_path"), base).alias("url"),
    )


def found_posters(
    saved: DataFrame, movies: DataFrame, links: DataFrame, catalogue: DataFrame, base: str = IMAGE_BASE
) -> DataFrame:
    """What can be found for films that the saved map lacks."""
    todo = movies.join(saved, "movieId", "left_anti")
    found = resolve_posters(todo, links, catalogue, base).filter(F.col("url").isNotNull())
    return found.select("movieId", saved_size(F.col("url")).alias("url"))


def upsert_posters(
    saved: DataFrame, movies: DataFrame, links: DataFrame, catalogue: DataFrame, base: str = IMAGE_BASE
) -> DataFrame:
    """Saved map plus what can be found for films it lacks; saved entries never change."""
    return saved.select("movieId", "url").unionByName(found_posters(saved, movies, links, catalogue, base))


def missing_posters(movies: DataFrame, posters: DataFrame) -> DataFrame:
    return movies.select("movieId", "title").join(posters, "movieId", "left_anti")


def match_coverage(movies: DataFrame, posters: DataFrame) -> DataFrame:
    """Films in the map over films in the catalogue, in percent."""
    n_movies = movies.agg(F.count(F.lit(1))).scalar()
    return posters.agg(F.count(F.lit(1)).alias("n_posters")).select(
        "n_posters",
        n_movies.alias("n_movies"),
        F.round(100.0 * F.col("n_posters") / n_movies, 1).alias("coverage_pct"),
    )


def own_or_saved_url(movies: DataFrame, own: DataFrame, saved: DataFrame) -> DataFrame:
    """A film's own address unless blank, else the saved one, else null."""
    return (
        movies.select("movieId")
        .join(own.select("movieId", F.col("url").alias("own_url")), "movieId", "left")
        .join(saved.select("movieId", F.col("url").alias("saved_url")), "movieId", "left")
        .select("movieId", F.coalesce(F.nullif("own_url", F.lit("")), F.nullif("saved_url", F.lit(""))).alias("url"))
    )
