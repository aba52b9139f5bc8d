"""Implicit feedback: what users did, counted, as confidence that they like an item."""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, functions as F

from filmfold.operators import model

#: What an event of a kind adds to the count; kinds that are not named say nothing about taste.
WEIGHTS = {"view": 1, "click": 2, "purchase": 4}
#: How much a counted event adds to the confidence in a preference.
ALPHA = 40.0


def counted(events: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """userId, movieId, rating: the weighted count of a user's events with an item (userId, movieId, event_type).

    Counts are summed in every task before they are shuffled by user and item,
    so a user or item with very many events is spread. Rows without user or item
    and kinds without weight are left out.
    """
    weights = weights or WEIGHTS
    weight = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(w)) for kind, w in weights.items()])
    known = events.filter("userId IS NOT NULL AND movieId IS NOT NULL").withColumn("weight", weight)
    return known.filter("weight IS NOT NULL").groupBy("userId", "movieId").agg(F.sum("weight").cast("double").alias("rating"))


def confidence(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add preference (1 for any count) and the confidence in it, 1 + alpha * count: what the model weighs errors by."""
    return counts.withColumn("preference", (F.col("rating") > 0).cast("int")).withColumn(
        "confidence", 1 + alpha * F.col("rating"))


def train(counts: DataFrame, alpha: float = ALPHA, **params) -> ALSModel:
    """Non-negative factors of the preferences, weighed by confidence; scores rank items, they are no stars."""
    params.setdefault("blocks", model.block_count(counts))
    als = model.estimator(counts.sparkSession, **params)
    return als.setImplicitPrefs(True).setAlpha(alpha).fit(model.als_input(counts))
