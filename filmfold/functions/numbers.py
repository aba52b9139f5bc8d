"""The three rounding rules in use, quantising and score display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Banker's rounding. Exact for float32 scores widened to double: their
    decimal text ends in a lone 5 only when the binary value is a true tie."""
    return F.bround(value.cast("double"), digits)


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Halves go towards plus infinity, also below zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def shown_score(score: Column) -> Column:
    """Score for display: never above 5, one decimal. Stored scores stay unclamped."""
    return F.round(F.least(F.lit(5.0), score), 1)


def quantise(features: Column, scale: int = 1000) -> Column:
    """Vector to integers, half-even."""
    return F.transform(features, lambda x: F.bround(x.cast("double") * scale, 0).cast("int"))


def dequantise(features: Column, scale: int = 1000) -> Column:
    return F.transform(features, lambda x: x.cast("double") / scale)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two vectors in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
