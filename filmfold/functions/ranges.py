"""Era and reach ranges as literal expressions: a range match is no join."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmfold import fixed

NO_END = 2**31 - 1


def matching_eras(year: Column) -> Column:
    """Names of every era the year falls in (0 = unknown year matches open starts)."""
    return F.array_compact(
        F.array(*[F.when(year.between(lo, hi), F.lit(name)) for name, (lo, hi) in fixed.ERAS.items()])
    )


def matching_reaches(count: Column, reach: dict) -> Column:
    """Names of every popularity range the rating count falls in; ranges overlap."""
    return F.array_compact(
        F.array(*[
            F.when(count.between(lo, NO_END if hi is None else hi), F.lit(name))
            for name, (lo, hi) in reach.items()
        ])
    )


def known_era(era: Column) -> Column:
    return F.when(era.isin(*fixed.ERAS), era).otherwise(F.lit(fixed.DEFAULT_ERA))


def known_reach(reach: Column) -> Column:
    return F.when(reach.isin(*fixed.REACH), reach).otherwise(F.lit(fixed.DEFAULT_REACH))


def range_end(name: Column, ranges: dict, end: int) -> Column:
    """Lower (0) or upper (1) end of a named range."""
    pairs = []
    for key, bounds in ranges.items():
        value = NO_END if bounds[end] is None else bounds[end]
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)[name]
