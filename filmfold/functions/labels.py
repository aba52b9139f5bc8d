"""Code lists and time stamps turned into readable values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmfold import fixed


def _lookup(pairs, key: Column) -> Column:
    flat = [F.lit(x) for pair in pairs for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def age_label(age: Column) -> Column:
    return _lookup(fixed.AGE_LABELS.items(), age)


def occupation_label(code: Column) -> Column:
    return _lookup(enumerate(fixed.OCCUPATIONS), code)


def reaction_stars(reaction: Column) -> Column:
    """Stars of a reaction, null for a reaction that counts for nothing."""
    return _lookup(fixed.REACTION_STARS.items(), reaction)


def rated_at(epoch_seconds: Column) -> Column:
    return F.timestamp_seconds(epoch_seconds)
