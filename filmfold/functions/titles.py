"""Title parsing as column expressions (no UDF, stays in generated code)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmfold import fixed


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _article_tail(articles: list[str]) -> str:
    return r"^(.*), (" + "|".join(articles) + r")$"


def release_year(title: Column) -> Column:
    """Trailing ``(YYYY)`` as int, null when the title has none."""
    return F.nullif(F.regexp_extract(title, fixed.YEAR_SUFFIX, 1), F.lit("")).cast("int")


def release_year_or_zero(title: Column) -> Column:
    """Trailing ``(YYYY)``, 0 standing for an unknown year as in the film table."""
    return F.coalesce(release_year(title), F.lit(0))


def display_title(title: Column) -> Column:
    """Title for display: no year, no trailing alternates, article in front."""
    bare = F.regexp_replace(title, fixed.DISPLAY_YEAR_TAIL, "$1")
    bare = _strip(F.regexp_replace(bare, fixed.DISPLAY_ALTERNATES, ""))
    return F.regexp_replace(bare, _article_tail(fixed.DISPLAY_ARTICLES), "$2 $1")


def display_year(title: Column) -> Column:
    """Year shown next to the display title; the gap before ``(`` is required."""
    return F.nullif(F.regexp_extract(title, fixed.DISPLAY_YEAR_TAIL, 2), F.lit("")).cast("int")


def _search_name(name: Column) -> Column:
    name = F.regexp_replace(_strip(name), fixed.ALSO_KNOWN_AS, "")
    tail = _article_tail(fixed.SEARCH_ARTICLES)
    # an elided article joins its noun without the space
    moved = F.replace(F.regexp_replace(name, tail, "$2 $1"), F.lit("L' "), F.lit("L'"))
    return F.when(F.rlike(name, F.lit(tail)), moved).otherwise(name)


def search_names(title: Column) -> Column:
    """Names to look a title up by, best first: main name, then its alternates."""
    base = _strip(F.regexp_replace(title, fixed.YEAR_TAIL, ""))
    main = _strip(F.regexp_replace(base, fixed.ALTERNATE_WITH_GAP, ""))
    alternates = F.regexp_extract_all(base, F.lit(fixed.ALTERNATE), F.lit(1))
    names = F.transform(F.concat(F.array(main), alternates), _search_name)
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def search_years(title: Column) -> Column:
    """Years to try in order: the stated one, one before, one after, then any (null)."""
    year = release_year(title)
    unknown = F.lit(None).cast("int")
    return F.when(year.isNotNull(), F.array(year, year - 1, year + 1, unknown)).otherwise(
        F.array(unknown)
    )
