"""Tables and models that several queries share, written once per application.

They go to the shared folder, not to executor memory or local disk, so a lost
executor costs nothing and later queries start from files, not from lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession

from filmfold.operators import films, model, recommend
from filmfold.session import materialise, scratch_path
from filmfold.sources import layout, views

_DONE: dict[tuple[str, tuple, str], object] = {}


def _inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of every input file, so that changed tables are not answered from old copies."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table in files.listStatus(folder):
        inside = files.listStatus(table.getPath()) if table.isDirectory() else [table]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inside]
    return tuple(sorted(found))


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, _inputs(spark, sf_dir), name)
    if key not in _DONE:
        _DONE[key] = make()
    return _DONE[key]


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` describes, from Parquet."""
    return _once(spark, sf_dir, name, lambda: materialise(build(), name))


def film_table(spark: SparkSession, sf_dir: str, min_ratings: int) -> DataFrame:
    return written(
        spark, sf_dir, f"films-{min_ratings}",
        lambda: films.film_table(
            ratings_table(spark, sf_dir), views.movies(spark, sf_dir),
            views.item_factors(spark, sf_dir), min_ratings,
        ),
    )


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top films by given vectors, for users with ratings, before exclusion."""
    return written(
        spark, sf_dir, "vector-top",
        lambda: recommend.picks_from_vectors(
            views.user_factors(spark, sf_dir), views.item_factors(spark, sf_dir),
            views.ratings(spark, sf_dir),
        ),
    )


def vector_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top films by given vectors, with rated films removed."""
    return written(
        spark, sf_dir, "vector-picks",
        lambda: recommend.exclude_rated(vector_top(spark, sf_dir), views.ratings(spark, sf_dir)),
    )


def ratings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as a written table, for work that reads them more than once."""
    return written(spark, sf_dir, "ratings", lambda: views.ratings(spark, sf_dir))


def reactions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions as a written table: the films that count and the pairs to fit both start from them."""
    return written(spark, sf_dir, "reactions",
                   lambda: views.request_reactions(spark, sf_dir, ratings_table(spark, sf_dir)))


def ratings_by_user(spark: SparkSession, sf_dir: str) -> layout.UserTable:
    """Ratings clustered by user."""
    return _once(spark, sf_dir, "ratings-by-user", lambda: layout.cluster(ratings_table(spark, sf_dir)))


def picks_by_user(spark: SparkSession, sf_dir: str) -> layout.UserTable:
    """Top films by given vectors, before exclusion, clustered like the ratings."""
    return _once(spark, sf_dir, "picks-by-user", lambda: layout.cluster(
        vector_top(spark, sf_dir), like=ratings_by_user(spark, sf_dir)))


def vectors_by_user(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """User vectors (id, features) as ``build`` gives them, bucketed by userId."""
    def make() -> DataFrame:
        vectors = build().withColumnRenamed("id", "userId")
        buckets = layout.bucket_count(spark, vectors.count())
        return layout.bucketed(vectors, scratch_path(spark, "vectors"), "userId", buckets, ["userId"])

    return _once(spark, sf_dir, f"vectors-by-user-{name}", make)


def titles_by_film(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue sorted by film over all files, so that a few ids are a few row groups."""
    return written(spark, sf_dir, "titles", lambda: views.movies(spark, sf_dir).repartitionByRange(
        "movieId").sortWithinPartitions("movieId"))


def model_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the model trained on the 80 % hash split, trained on first use."""
    def make() -> str:
        path = scratch_path(spark, "als-model")
        train_set, _ = model.hash_split(ratings_table(spark, sf_dir))
        model.save(model.train(train_set), path)
        return path

    return _once(spark, sf_dir, "als-model", make)


def trained_model(spark: SparkSession, sf_dir: str) -> ALSModel:
    return model.load(model_path(spark, sf_dir))


def model_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top films of every user by the trained model, before exclusion."""
    return written(
        spark, sf_dir, "model-top",
        lambda: recommend.picks_from_model(trained_model(spark, sf_dir)),
    )
