"""Recommendations for newcomers: preferences and a few reactions in, ten films out.

A request is a row (reqId, genres, era, reach); the reactions sent with it are
rows (reqId, movieId, reaction). What depends only on the choice of genres and
era - the anchor films and their share of the least-squares sums - is worked
out once per distinct choice and joined to the requests, however many share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmfold import fixed
from filmfold.functions import genres as G, labels as L, numbers as N, ranges as R
from filmfold.functions.solver import fold_in_solver
from filmfold.operators import films as films_op, scoring
from filmfold.operators.skew import plain_join
from filmfold.session import materialise

CHOICE = ["wanted", "era"]
PIECE_ROWS = 10_000  # ratings of one request summed together


def expand_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests that carry a ratings map into (requests, reactions)."""
    reactions = requests.select("reqId", F.explode("ratings").alias("movieId", "reaction"))
    return requests.drop("ratings"), reactions


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Wanted mask, known era and known reach; no genres means all genres."""
    return requests.select(
        "reqId",
        G.wanted_mask(F.col("genres")).alias("wanted"),
        R.known_era(F.col("era")).alias("era"),
        R.known_reach(F.col("reach")).alias("reach"),
    )


def rated_films(reactions: DataFrame, films: DataFrame) -> DataFrame:
    """Reactions that count, as (reqId, movieId, r) with r in stars: the reaction
    is known and the film is in the table."""
    stars = reactions.select("reqId", "movieId", L.reaction_stars(F.col("reaction")).alias("r"))
    return stars.filter("r IS NOT NULL").join(films.select("movieId"), "movieId", "left_semi").select(
        "reqId", "movieId", "r"
    )


def _by_score() -> list:
    return [F.desc("score"), F.desc("cnt"), F.asc("movieId")]


def genre_leaders(films: DataFrame, tiers: list[int], size: int = fixed.ANCHOR_LIST) -> DataFrame:
    """Best ``size`` films of every (genre, era, tier).

    A film among the best of several genres taken together is also among the
    best of each of its own genres, so these lists hold every possible anchor.
    They have at most 18 x 4 x tiers x size rows, whatever the catalogue.
    """
    reached = F.array_compact(F.array(*[
        F.when(F.col("cnt") >= least, F.lit(tier)) for tier, least in enumerate(tiers)
    ]))
    spread = films_op.films_by_era(films).select(
        "*", F.explode(G.mask_bits(F.col("mask"))).alias("bit")
    ).select("*", F.explode(reached).alias("tier"))
    best = Window.partitionBy("bit", "era", "tier").orderBy(*_by_score())
    return spread.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size).select(
        "bit", "era", "tier", "movieId", "score", "cnt", "features"
    )


def anchors(
    choices: DataFrame, films: DataFrame, tiers: list[int] | None = None,
    size: int = fixed.ANCHOR_LIST, enough: int = fixed.ANCHOR_ENOUGH,
) -> DataFrame:
    """Anchor films of each (wanted, era): the strictest tier with enough films,
    else the most-rated films of the whole table.

    Returns (wanted, era, tier, anchors array<struct<pos, movieId, features>>);
    ``tier`` is null where the fallback list was used.
    """
    tiers = tiers or fixed.ANCHOR_TIERS
    choices = choices.select(*CHOICE).distinct()
    hit = F.struct("tier", (-F.col("score")).alias("s"), (-F.col("cnt")).alias("c"), "movieId", "features")
    hits = (
        choices.select(*CHOICE, F.explode(G.mask_bits(F.col("wanted"))).alias("bit"))
        # bounded: 18 genres x 4 eras x tiers x size rows at most
        .join(F.broadcast(genre_leaders(films, tiers, size)), ["bit", "era"])
        # at most 18 x tiers x size entries per choice; the set drops films met through two genres
        .groupBy(*CHOICE).agg(F.collect_set(hit).alias("hits"))
    )

    def best_of(tier: int) -> Column:
        return F.slice(F.array_sort(F.filter("hits", lambda h: h["tier"] == tier)), 1, size)

    enough_at = [F.when(F.size(best_of(t)) >= enough, best_of(t)) for t in range(len(tiers))]
    chosen = hits.select(*CHOICE, F.coalesce(*enough_at).alias("best")).select(
        *CHOICE,
        F.col("best")[0]["tier"].alias("tier"),
        F.transform("best", lambda h, i: F.struct(
            (i + 1).alias("pos"), h["movieId"].alias("movieId"), h["features"].alias("features")
        )).alias("anchors"),
    )
    head = films.orderBy(F.desc("cnt"), "movieId").limit(size)
    by_count = F.row_number().over(Window.orderBy(F.desc("cnt"), "movieId"))  # size rows
    entry = F.struct("pos", "movieId", "features")
    fallback = head.withColumn("pos", by_count).agg(F.array_sort(F.collect_list(entry))).scalar()
    return choices.join(chosen, CHOICE, "left").select(
        *CHOICE, "tier", F.coalesce("anchors", fallback).alias("anchors")
    )


def anchor_weight(n_rated: Column) -> Column:
    """Weight of an anchor: it halves once a newcomer has rated ANCHOR_HALF_LIFE films, and so on."""
    return F.lit(fixed.ANCHOR_WEIGHT * fixed.ANCHOR_HALF_LIFE) / (fixed.ANCHOR_HALF_LIFE + n_rated)


def fold_in_rows(prepared: DataFrame, rated: DataFrame, films: DataFrame, **ladder) -> DataFrame:
    """Every (reqId, movieId, r, w) that enters the fold-in: anchors, then rated
    films. A film that is both counts twice."""
    rated = rated.select("reqId", "movieId", F.col("r").cast("double").alias("r"))
    counts = rated.groupBy("reqId").agg(F.count(F.lit(1)).alias("n_rated"))
    chosen = plain_join(prepared, anchors(prepared, films, **ladder), CHOICE).join(counts, "reqId", "left")
    anchor_rows = chosen.select(
        "reqId",
        F.lit("anchor").alias("source"),
        F.explode(F.transform("anchors", lambda a: a["movieId"])).alias("movieId"),
        F.lit(float(fixed.ANCHOR_STARS)).alias("r"),
        anchor_weight(F.coalesce("n_rated", F.lit(0))).alias("w"),
    )
    rated_rows = rated.select("reqId", F.lit("rated").alias("source"), "movieId", "r", F.lit(1.0).alias("w"))
    return anchor_rows.unionByName(rated_rows)


def _upper(rank: int) -> list[tuple[int, int]]:
    return [(a, c) for a in range(rank) for c in range(a, rank)]


def vector_length(films: DataFrame) -> int:
    """Length of the films' vectors, which is the rank of the model they come from; 0 without films."""
    return films.agg(F.coalesce(F.max(F.size("features")), F.lit(0)).alias("n")).first()["n"]


def whole_vectors(rank: int) -> Column:
    """Vectors in thousandths, as they are stored; sums over them are exact in any order.

    A vector of another length is an error, never cut or filled up."""
    q = N.quantise(F.col("features"))
    wrong = F.raise_error(F.concat(
        F.lit(f"expected vectors of {rank} values, found "), F.coalesce(F.size("features").cast("string"), F.lit("none"))
    ))
    return F.when(F.size("features") == rank, q).otherwise(wrong)


def _sums(v: list[str], r: str) -> list[Column]:
    """Upper triangle of sum(v v^T) and sum(r v) as sums of whole numbers."""
    v = [f"CAST({x} AS BIGINT)" for x in v]
    gram = [F.expr(f"sum({v[a]} * {v[c]}) AS g_{a}_{c}") for a, c in _upper(len(v))]
    return gram + [F.expr(f"sum(CAST({r} AS BIGINT) * {name}) AS b_{a}") for a, name in enumerate(v)]


def _gram(rank: int, name: str) -> Column:
    return F.expr("array(" + ", ".join(f"g_{a}_{c}" for a, c in _upper(rank)) + f") AS {name}")


def _rhs(rank: int, name: str) -> Column:
    return F.expr("array(" + ", ".join(f"b_{a}" for a in range(rank)) + f") AS {name}")


BITS = range(len(fixed.GENRES))


def rated_sums(
    rated: DataFrame, films: DataFrame, rank: int, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Per request, from its rated films: count, Gram matrix, right-hand side and
    genre gains, all in one aggregation of whole numbers (gains are doubled).

    A row of sums is many times wider than a rating, and most requests have few
    ratings, so summing in every task first would blow the shuffle up. Ratings
    are shuffled to their request instead, and only requests with more than
    ``piece_rows`` of them are cut into pieces that are summed apart; the sums
    are whole numbers, so the cut cannot be seen in them. A vector travels as one
    array of integers and is taken apart after the shuffle.
    """
    large = (
        rated.groupBy("reqId").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > piece_rows)
        .select("reqId", F.ceil(F.col("n") / piece_rows).alias("pieces"))
    )
    inputs = films.select("movieId", "mask", whole_vectors(rank).alias("q"))
    gains = [
        F.expr(f"sum(IF(mask & {1 << bit} != 0, CAST(r AS BIGINT) - 3, 0)) AS t_{bit}") for bit in BITS
    ]
    vector = [f"q[{a}]" for a in range(rank)]
    sums = [F.count(F.lit(1)).alias("n_rated"), *_sums(vector, "r"), *gains]

    usual = rated.join(large, "reqId", "left_anti").join(inputs, "movieId")
    usual = usual.repartition("reqId").groupBy("reqId").agg(*sums)
    piece = F.pmod(F.xxhash64("movieId"), F.col("pieces")).alias("piece")
    cut = rated.join(large, "reqId").select("reqId", "movieId", "r", piece).join(inputs, "movieId")
    cut = cut.repartition("reqId", "piece").groupBy("reqId", "piece").agg(*sums).drop("piece")
    cut = cut.groupBy("reqId").agg(*[F.expr(f"sum({c}) AS {c}") for c in cut.columns if c != "reqId"])
    return usual.unionByName(cut).select(
        "reqId", "n_rated", _gram(rank, "rated_gram"), _rhs(rank, "rated_rhs"),
        F.expr("array(" + ", ".join(f"t_{bit}" for bit in BITS) + ") AS gains"),
    )


def anchor_sums(choice_anchors: DataFrame, rank: int) -> DataFrame:
    """The same sums for each choice's anchors at weight 1."""
    spread = choice_anchors.select(*CHOICE, F.inline("anchors")).select(*CHOICE, whole_vectors(rank).alias("q"))
    return (
        spread.groupBy(*CHOICE)
        .agg(F.count(F.lit(1)).alias("n_anchors"),
             *_sums([f"q[{k}]" for k in range(rank)], str(fixed.ANCHOR_STARS)))
        .select(*CHOICE, "n_anchors", _gram(rank, "anchor_gram"), _rhs(rank, "anchor_rhs"))
    )


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), n)


def normal_equations(
    prepared: DataFrame, rated: DataFrame, films: DataFrame,
    reg_param: float = fixed.REG_PARAM, rank: int | None = None, **ladder,
) -> DataFrame:
    """One row per request: Gram matrix (upper triangle), right-hand side, ridge
    term and genre affinity. The ridge scales with the sum of weights.

    ``rank`` is that of the films' vectors unless given. Whole-number sums of
    anchors and of rated films are weighted, added and scaled once, so the
    result does not depend on how the rows were spread."""
    rank = vector_length(films) if rank is None else rank
    shared = anchor_sums(anchors(prepared, films, **ladder), rank)
    own = rated_sums(rated, films, rank)
    w = F.col("anchor_w")

    def weighted(anchor: str, rated: str, n: int, scale: int) -> Column:
        rated_part = F.coalesce(F.col(rated), _zeros(n))
        anchor_part = F.coalesce(F.col(anchor), _zeros(n))
        return F.zip_with(anchor_part, rated_part, lambda a, b: (w * a + b) / F.lit(float(scale)))

    chosen = G.chosen_bits(F.col("wanted"))
    gains = F.coalesce("gains", _zeros(len(BITS)))
    n_rated = F.coalesce("n_rated", F.lit(0))
    return (
        prepared.join(shared, CHOICE, "left").join(own, "reqId", "left")
        .withColumn("anchor_w", anchor_weight(n_rated))
        .select(
            "reqId", "wanted", "era", "reach",
            n_rated.alias("n_rated"),
            weighted("anchor_gram", "rated_gram", len(_upper(rank)), fixed.QUANT_SCALE**2).alias("gram"),
            weighted("anchor_rhs", "rated_rhs", rank, fixed.QUANT_SCALE).alias("rhs"),
            (reg_param * (w * F.coalesce("n_anchors", F.lit(0)) + n_rated)).alias("ridge"),
            F.zip_with(chosen, gains, lambda a, b: a + b / 2).alias("affinity"),
        )
    )


def gram_cells(equations: DataFrame, rank: int) -> DataFrame:
    """Gram matrix in long form, cells with a <= c, without the ridge term."""
    at = F.expr("array(" + ", ".join(f"named_struct('a', {a}, 'c', {c})" for a, c in _upper(rank)) + ")[cell]")
    cells = equations.select("reqId", F.posexplode("gram").alias("cell", "value"))
    return cells.select("reqId", at.alias("at"), "value").select("reqId", "at.a", "at.c", "value")


def rhs_cells(equations: DataFrame) -> DataFrame:
    return equations.select("reqId", F.posexplode("rhs").alias("a", "value"))


def solve(equations: DataFrame, rank: int) -> DataFrame:
    """Add the taste vector: regularised, weighted, non-negative least squares."""
    return equations.withColumn("vector", fold_in_solver(rank)("gram", "rhs", "ridge"))


def request_affinity(equations: DataFrame) -> DataFrame:
    """Genre affinity in long form."""
    names = F.array(*[F.lit(g) for g in fixed.GENRES])
    return equations.select("reqId", F.posexplode("affinity").alias("bit", "affinity")).select(
        "reqId", names[F.col("bit")].alias("genre"), "affinity"
    )


def genre_fit(equations: DataFrame, pairs: DataFrame, films: DataFrame) -> DataFrame:
    """Fit of given (reqId, movieId) pairs."""
    with_mask = pairs.join(films.select("movieId", "mask"), "movieId")
    return (
        plain_join(with_mask, equations.select("reqId", "affinity"), ["reqId"])
        .select("reqId", "movieId", G.genre_fit(F.col("mask"), F.col("affinity")).alias("fit"))
    )


def candidate_counts(prepared: DataFrame, films: DataFrame, reach: dict = fixed.REACH) -> DataFrame:
    """How many films pass each request's genre, era and reach filters.

    Films are counted per (mask, era, reach) cell and requests reduced to
    distinct choices; the range and any-genre tests become equality on
    (genre, era, reach), and a cell met through several genres counts once.
    """
    cells = (
        films_op.films_by_reach(films_op.films_by_era(films), reach)
        .groupBy("mask", "era", "reach").agg(F.count(F.lit(1)).alias("n"))
        .select("*", F.explode(G.mask_bits(F.col("mask"))).alias("bit"))
    )
    keys = [*CHOICE, "reach"]
    choices = prepared.select(*keys).distinct()
    met = (
        choices.select(*keys, F.explode(G.mask_bits(F.col("wanted"))).alias("bit"))
        .join(cells, ["bit", "era", "reach"])
        .groupBy(*keys, "mask").agg(F.first("n").alias("n"))
        .groupBy(*keys).agg(F.sum("n").alias("n_candidates"))
    )
    return plain_join(prepared, met, keys, "left").select(
        "reqId", *keys, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")
    )


def rank_for_requests(
    vectors: DataFrame, films: DataFrame, seen: DataFrame, k: int = fixed.TOP_N,
    reach: dict = fixed.REACH, bonus: float = fixed.GENRE_BONUS, **kwargs,
) -> DataFrame:
    """Best k films per request by predicted score plus genre fit.

    ``vectors`` has (reqId, wanted, era, reach, affinity, vector). Films that
    were rated with the request (``seen``) are left out before ranking;
    anchors are not. The reported score is the prediction alone.
    """
    queries = vectors.select(
        F.col("reqId").alias("qid"), "vector", "wanted",
        R.range_end(F.col("era"), fixed.ERAS, 0).alias("year_from"),
        R.range_end(F.col("era"), fixed.ERAS, 1).alias("year_to"),
        R.range_end(F.col("reach"), reach, 0).alias("cnt_min"),
        R.range_end(F.col("reach"), reach, 1).alias("cnt_max"),
        "affinity",
    )
    items = films.select(F.col("movieId").alias("id"), F.col("features").alias("vector"), "mask", "year", "cnt")
    excluded = seen.select(F.col("reqId").alias("qid"), F.col("movieId").alias("id"))
    best = scoring.top_k(
        queries, items, k, excluded=excluded, filtered=True, bonus=bonus, **kwargs
    )
    return best.select(
        F.col("qid").alias("reqId"), "rank", F.col("id").alias("movieId"),
        N.round_half_up(F.col("score")).alias("predictedRating"), "score", "rank_score",
    )


def recommend_for_requests(
    requests: DataFrame, reactions: DataFrame, films: DataFrame, k: int = fixed.TOP_N,
    reach: dict = fixed.REACH, **ladder,
) -> DataFrame:
    """The whole path: anchors, fold-in, filters, ranking. The reactions that
    count are used twice, so they are worked out once and written."""
    prepared = prepare_requests(requests)
    rated = materialise(rated_films(reactions, films), "rated")
    rank = vector_length(films)
    equations = normal_equations(prepared, rated, films, rank=rank, **ladder)
    return rank_for_requests(solve(equations, rank), films, rated, k, reach, counted=requests)
