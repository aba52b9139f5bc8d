import pytest
from pyspark.sql import functions as F

from filmfold import fixed
from filmfold.functions import genres as G, labels as L, numbers as N, ranges as R, titles as T

TITLES = [
    # title, search names, year, display title
    ("Matrix, The (1999)", ["The Matrix"], 1999, "The Matrix"),
    ("Seven (Se7en) (1995)", ["Seven", "Se7en"], 1995, "Seven"),
    ("Sunset Blvd. (a.k.a. Sunset Boulevard) (1950)", ["Sunset Blvd.", "Sunset Boulevard"], 1950, "Sunset Blvd."),
    ("Twice (A.K.A. Two Times) (Twice) (1980)", ["Twice", "Two Times"], 1980, "Twice"),
    ("Seven Samurai (The Magnificent Seven) (Shichinin no samurai) (1954)",
     ["Seven Samurai", "The Magnificent Seven", "Shichinin no samurai"], 1954, "Seven Samurai"),
    ("Double Life of Veronique, The (La Double Vie de Véronique) (1991)",
     ["The Double Life of Veronique", "La Double Vie de Véronique"], 1991, "The Double Life of Veronique"),
    ("2001: A Space Odyssey (1968)", ["2001: A Space Odyssey"], 1968, "2001: A Space Odyssey"),
    ("Avventura, L' (1960)", ["L'Avventura"], 1960, "Avventura, L'"),
    ("Olvidados, Los (1950)", ["Los Olvidados"], 1950, "Olvidados, Los"),
    ("No Year, A", ["A No Year"], None, "A No Year"),
    ("Up (II) (2009)", ["Up", "II"], 2009, "Up (II)"),
    ("Them, Then (1954)  ", ["Them, Then"], 1954, "Them, Then"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, title string")
    t = F.col("title")
    rows = df.select(
        "i", T.search_names(t).alias("names"), T.release_year(t).alias("year"),
        T.display_title(t).alias("display"), T.display_year(t).alias("shown"), T.search_years(t).alias("years"),
        T.release_year_or_zero(t).alias("zero"),
    ).collect()
    return {r.i: r for r in rows}


@pytest.mark.parametrize("i", range(len(TITLES)))
def test_titles(parsed, i):
    _, names, year, display = TITLES[i]
    row = parsed[i]
    assert row.names == names
    assert row.year == year and row.zero == (year or 0) and row.shown == year
    assert row.display == display
    assert row.years == ([year, year - 1, year + 1, None] if year else [None])


def test_year_without_gap_is_only_seen_by_the_matcher(spark):
    row = spark.createDataFrame([("Foo(1999)",)], "t string").select(
        T.release_year(F.col("t")).alias("a"), T.display_year(F.col("t")).alias("b"),
        T.display_title(F.col("t")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (1999, None, "Foo(1999)")


def test_genres_to_mask_and_back(spark):
    df = spark.createDataFrame(
        [("Action|Western",), ("",), (None,), ("Nonsense|Drama||Drama",)], "g string"
    ).select(G.split_genres(F.col("g")).alias("a"))
    rows = df.select(
        "a", G.genre_mask(F.col("a")).alias("m"), G.wanted_mask(F.col("a")).alias("w"),
    ).withColumn("bits", G.mask_bits(F.col("m"))).withColumn("names", G.mask_genres(F.col("m"))).collect()
    assert [r.a for r in rows] == [["Action", "Western"], [], [], ["Nonsense", "Drama", "Drama"]]
    assert [r.m for r in rows] == [1 | 1 << 17, 0, 0, 1 << 7]
    assert [r.w for r in rows] == [1 | 1 << 17, fixed.ALL_GENRES_MASK, fixed.ALL_GENRES_MASK, 1 << 7]
    assert [r.bits for r in rows] == [[0, 17], [], [], [7]]
    assert rows[0].names == ["Action", "Western"] and rows[3].names == ["Drama"]


def test_genre_fit(spark):
    affinity = [0.0] * 18
    affinity[0], affinity[1], affinity[2] = 4.0, 1.0, -2.0
    df = spark.createDataFrame([(0b1,), (0b11,), (0b100,), (0,)], "m int").withColumn(
        "a", F.array(*[F.lit(x) for x in affinity])
    )
    fits = [r.f for r in df.select(G.genre_fit(F.col("m"), F.col("a")).alias("f")).collect()]
    assert fits == pytest.approx([1.0, (1 + 0.625) / 2, -0.5, 0.0])


def test_mood_genres(spark):
    rows = spark.createDataFrame([("scare",), (None,), ("unknown",)], "m string").select(
        G.mood_genres(F.col("m")).alias("g")
    ).collect()
    assert [r.g for r in rows] == [["Horror"], [], []]


def test_ranges_at_their_ends(spark):
    df = spark.createDataFrame([(0, 39), (1969, 40), (1970, 500), (1989, 501), (1990, 800)], "y int, c int")
    rows = df.select(
        R.matching_eras(F.col("y")).alias("e"), R.matching_reaches(F.col("c"), fixed.REACH).alias("r")
    ).collect()
    assert [r.e for r in rows] == [
        ["any", "classic"], ["any", "classic"], ["any", "7080"], ["any", "7080"], ["any", "90s"],
    ]
    assert [r.r for r in rows] == [[], ["gems"], ["balanced", "gems"], ["balanced"], ["popular", "balanced"]]
    defaults = spark.createDataFrame([("lost", None), ("90s", "gems")], "e string, r string").select(
        R.known_era(F.col("e")).alias("e"), R.known_reach(F.col("r")).alias("r")
    ).collect()
    assert [(d.e, d.r) for d in defaults] == [("any", "balanced"), ("90s", "gems")]


def test_three_roundings(spark):
    values = [0.125, 0.375, 2.5, -0.125, 5.75, 3.14159]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    rows = df.select(
        N.round_half_even(v).alias("even"), N.round_half_up(v).alias("up"), N.shown_score(v).alias("shown")
    ).collect()
    assert [r.even for r in rows] == [round(v, 2) for v in values]
    assert [r.up for r in rows] == [0.13, 0.38, 2.5, -0.12, 5.75, 3.14]
    assert [r.shown for r in rows] == [0.1, 0.4, 2.5, -0.1, 5.0, 3.1]


def test_half_even_matches_python_on_float32_scores(spark):
    import numpy as np
    scores = np.random.default_rng(0).uniform(0, 6, 2000).astype(np.float32)
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    got = [r.x for r in df.select(N.round_half_even(F.col("s").cast("float")).alias("x")).collect()]
    assert got == [round(float(s), 2) for s in scores]


def test_quantise_half_even_and_back(spark):
    df = spark.createDataFrame([([0.0005, 0.0015, 0.0025, 1.2345],)], "f array<double>")
    row = df.select(N.quantise(F.col("f")).alias("q")).withColumn("d", N.dequantise(F.col("q"))).first()
    assert row.q == [0, 2, 2, 1234]
    assert row.d == pytest.approx([0.0, 0.002, 0.002, 1.234])


def test_labels(spark):
    row = spark.createDataFrame([(56, 20, "nope", "meh")], "a int, o int, r string, x string").select(
        L.age_label(F.col("a")).alias("a"), L.occupation_label(F.col("o")).alias("o"),
        L.reaction_stars(F.col("r")).alias("r"), L.reaction_stars(F.col("x")).alias("x"),
    ).first()
    assert (row.a, row.o, row.r, row.x) == ("56+", "writer", 2, None)
