"""Genre sets as pipe text, as arrays and as 18-bit masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmfold import fixed


def split_genres(genres: Column) -> Column:
    """Pipe text to array, blanks dropped; null text gives an empty array."""
    parts = F.split(F.coalesce(genres, F.lit("")), r"\|")
    return F.filter(parts, lambda g: g != "")


def _names() -> Column:
    return F.array(*[F.lit(g) for g in fixed.GENRES])


def genre_mask(genres: Column) -> Column:
    """Array of names to mask; unknown names set no bit, repeats set it once."""
    known = F.filter(_names(), lambda name: F.array_contains(genres, name))
    bits = F.transform(known, lambda name: F.array_position(_names(), name) - 1)
    return F.aggregate(bits, F.lit(0), lambda mask, bit: mask.bitwiseOR(
        F.call_function("shiftleft", F.lit(1), bit.cast("int"))
    ))


def wanted_mask(genres: Column) -> Column:
    """Mask of a request; choosing nothing means every genre."""
    return F.when(F.size(genres) > 0, genre_mask(genres)).otherwise(F.lit(fixed.ALL_GENRES_MASK))


def any_genre(mask: Column, wanted: Column) -> Column:
    """True when the masks share a genre; an empty mask never matches."""
    return mask.bitwiseAND(wanted) != 0


def mask_bits(mask: Column) -> Column:
    """Positions of the set bits, ascending: the equi-join form of a mask."""
    every = F.sequence(F.lit(0), F.lit(len(fixed.GENRES) - 1))
    return F.filter(every, lambda bit: F.call_function("getbit", mask, bit) == 1)


def mask_genres(mask: Column) -> Column:
    """Names of the set bits in bit order."""
    return F.filter(_names(), lambda name, bit: F.call_function("getbit", mask, bit) == 1)


def chosen_bits(mask: Column) -> Column:
    """One value per genre: 1.0 where the bit is set, else 0.0."""
    every = F.sequence(F.lit(0), F.lit(len(fixed.GENRES) - 1))
    return F.transform(every, lambda bit: F.call_function("getbit", mask, bit).cast("double"))


def mood_genres(mood: Column) -> Column:
    """Genres of a mood, empty when the mood is unknown or unset."""
    pairs = []
    for name, genres in fixed.MOODS.items():
        pairs += [F.lit(name), F.array(*[F.lit(g) for g in genres])]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), mood), F.array().cast("array<string>")
    )


def genre_fit(mask: Column, affinity: Column) -> Column:
    """How well a film's genres suit a taste: mean of the best and of all of them.

    ``affinity`` holds one value per genre; it is scaled by its largest value
    when that exceeds 1. A film without genres fits 0.
    """
    top = F.greatest(F.lit(1.0), F.array_max(affinity))
    mine = F.transform(mask_bits(mask), lambda bit: affinity[bit] / top)
    mean = F.aggregate(mine, F.lit(0.0), lambda total, a: total + a) / F.size(mine)
    return F.when(mask != 0, (F.array_max(mine) + mean) / 2).otherwise(F.lit(0.0))
