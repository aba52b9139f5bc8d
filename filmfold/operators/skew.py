"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filmfold.session import materialise


def plain_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows, possibly many with one key, to a side with at most one row per key.

    Adaptive execution splits a skewed partition by its measured bytes, into as
    many pieces as these ask for, but only where both inputs come straight from
    a scan or a shuffle. A side that is aggregated on the key would not, so it
    is written first; its size then also decides whether it is broadcast.
    """
    return many.join(materialise(one, "one-side"), keys, how)
