"""Fold-in and mood ranking against a plain numpy computation on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmfold import fixed
from filmfold.operators import films as films_op, foldin

TIERS = [60, 30, 10]
REACH = {"popular": (50, None), "balanced": (20, None), "gems": (5, 35)}
FILM_SCHEMA = "movieId int, title string, year int, mask int, cnt int, mean10 int, q array<int>"


def _film_rows(n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bits = rng.choice(18, size=rng.integers(0, 4), replace=False)
        q = rng.integers(0, 1500, 10) * (rng.random(10) < 0.7)
        rows.append((int(i * 2 + 1), f"Film {i}", int(rng.choice([0, 1955, 1969, 1970, 1989, 1990, 1999])),
                     int(sum(1 << b for b in bits)), int(rng.integers(5, 90)), int(rng.integers(10, 51)),
                     [int(x) for x in q]))
    return rows


REQUESTS = [
    (1, ["Horror"], "any", "balanced", {}),
    (2, [], "90s", "popular", {1: "loved", 3: "nope", 5: "liked", 7: "seen", 99999: "loved"}),
    (3, ["Comedy", "Romance", "Musical", "Animation", "Children's"], "lost", "mixed", {9: "nope", 11: "nope"}),
    (4, ["Western"], "classic", "gems", {i * 2 + 1: ["loved", "liked", "nope"][i % 3] for i in range(60)}),
    (5, ["Drama"], "7080", "gems", {1: "seen"}),
]


@pytest.fixture(scope="module")
def world(spark):
    rows = _film_rows()
    table = spark.createDataFrame(rows, FILM_SCHEMA)
    films = films_op.with_bayesian_score(films_op.decode_films(table))
    schema = "reqId int, genres array<string>, era string, reach string, ratings map<int,string>"
    requests, reactions = foldin.expand_requests(spark.createDataFrame(REQUESTS, schema))
    prior = sum(r[5] / 10 * r[4] for r in rows) / sum(r[4] for r in rows)
    plain = {
        r[0]: dict(id=r[0], year=r[2], mask=r[3], cnt=r[4], v=np.array(r[6]) / 1000,
                   score=(r[5] / 10 * r[4] + prior * 50) / (r[4] + 50))
        for r in rows
    }
    return films, requests, reactions, plain


def _wanted(genres):
    return sum(1 << fixed.GENRES.index(g) for g in genres) or fixed.ALL_GENRES_MASK


def _anchor_ids(plain, wanted, era):
    lo, hi = fixed.ERAS.get(era, fixed.ERAS["any"])
    for tier in TIERS:
        hits = [f for f in plain.values() if f["mask"] & wanted and f["cnt"] >= tier and lo <= f["year"] <= hi]
        if len(hits) >= 8:
            return [f["id"] for f in sorted(hits, key=lambda f: (-f["score"], -f["cnt"], f["id"]))[:20]]
    return [f["id"] for f in sorted(plain.values(), key=lambda f: (-f["cnt"], f["id"]))[:20]]


def _inputs(plain, request):
    _, genres, era, _, reactions = request
    rated = {i: fixed.REACTION_STARS[how] for i, how in reactions.items() if how in fixed.REACTION_STARS and i in plain}
    ids = _anchor_ids(plain, _wanted(genres), era)
    weight = 0.35 * 5 / (5 + len(rated))
    return rated, [(i, 5.0, weight) for i in ids] + [(i, float(r), 1.0) for i, r in rated.items()]


def _taste(plain, rows):
    """Ridge regression as least squares on stacked rows, dropping columns that come out negative."""
    x = np.array([plain[i]["v"] for i, _, _ in rows])
    r, w = np.array([r for _, r, _ in rows]), np.sqrt([w for _, _, w in rows])
    keep = np.ones(10, dtype=bool)
    while True:
        ridge = np.sqrt(fixed.REG_PARAM * (w**2).sum()) * np.eye(keep.sum())
        u = np.linalg.lstsq(np.vstack([x[:, keep] * w[:, None], ridge]),
                            np.concatenate([r * w, np.zeros(keep.sum())]), rcond=None)[0]
        full = np.zeros(10)
        full[keep] = u
        if (u >= 0).all():
            return full
        keep[keep] = u > 0
        if not keep.any():
            return np.zeros(10)


def _ranking(plain, request, k=10):
    _, genres, era, reach, _ = request
    rated, rows = _inputs(plain, request)
    u, wanted = _taste(plain, rows), _wanted(genres)
    affinity = np.array([float(wanted >> b & 1) for b in range(18)])
    for i, r in rated.items():
        affinity += [(r - 3) / 2 * (plain[i]["mask"] >> b & 1) for b in range(18)]
    affinity /= max(1.0, affinity.max())
    lo, hi = fixed.ERAS.get(era, fixed.ERAS["any"])
    least, most = REACH.get(reach, REACH["balanced"])
    out = []
    for f in plain.values():
        if f["mask"] & wanted and f["id"] not in rated and lo <= f["year"] <= hi and least <= f["cnt"] <= (most or 1e9):
            mine = [affinity[b] for b in range(18) if f["mask"] >> b & 1]
            out.append((u @ f["v"] + (max(mine) + sum(mine) / len(mine)) / 2, f["cnt"], f["id"], u @ f["v"]))
    out.sort(key=lambda t: (-t[0], -t[1], t[2]))
    return [(i, round(p, 6)) for _, _, i, p in out[:k]]


def test_anchors(spark, world):
    films, requests, _, plain = world
    found = {
        (r.wanted, r.era): [a.movieId for a in r.anchors]
        for r in foldin.anchors(foldin.prepare_requests(requests), films, TIERS).collect()
    }
    assert len(found) == len(REQUESTS)
    for _, genres, era, _, _ in REQUESTS:
        known = era if era in fixed.ERAS else "any"
        assert found[_wanted(genres), known] == _anchor_ids(plain, _wanted(genres), era)


def test_rows_and_sums_agree(spark, world):
    films, requests, reactions, plain = world
    prepared = foldin.prepare_requests(requests)
    rated = foldin.rated_films(reactions, films)
    rows = foldin.fold_in_rows(prepared, rated, films, tiers=TIERS).collect()
    equations = {r.reqId: r for r in foldin.normal_equations(prepared, rated, films, tiers=TIERS).collect()}
    for request in REQUESTS:
        expected = _inputs(plain, request)[1]
        got = [(r.movieId, r.r, r.w) for r in rows if r.reqId == request[0]]
        assert np.array(sorted(got)) == pytest.approx(np.array(sorted(expected)))
        x = np.array([plain[i]["v"] for i, _, _ in expected])
        w = np.array([w for _, _, w in expected])
        gram = (x * w[:, None]).T @ x
        e = equations[request[0]]
        assert e.gram == pytest.approx([gram[a, c] for a in range(10) for c in range(a, 10)])
        assert e.ridge == pytest.approx(fixed.REG_PARAM * w.sum())


def test_large_requests_are_summed_in_pieces(spark, world):
    films, _, reactions, _ = world
    rated = foldin.rated_films(reactions, films)
    whole = {r.reqId: r for r in foldin.rated_sums(rated, films, 10).collect()}
    cut = {r.reqId: r for r in foldin.rated_sums(rated, films, 10, piece_rows=7).collect()}
    assert set(cut) == set(whole) == {2, 3, 4}
    for i, r in whole.items():
        assert cut[i].n_rated == r.n_rated
        for name in ("rated_gram", "rated_rhs", "gains"):
            assert cut[i][name] == r[name]  # whole numbers: the same to the last digit


def test_taste_vectors(spark, world):
    films, requests, reactions, plain = world
    prepared, rated = foldin.prepare_requests(requests), foldin.rated_films(reactions, films)
    solved = foldin.solve(foldin.normal_equations(prepared, rated, films, tiers=TIERS), 10).collect()
    dropped = 0
    for r in solved:
        request = next(q for q in REQUESTS if q[0] == r.reqId)
        assert r.vector == pytest.approx(_taste(plain, _inputs(plain, request)[1]), abs=1e-9)
        dropped += sum(x == 0 for x in r.vector)
    assert dropped  # the sign constraint was at work


@pytest.mark.parametrize("pieces", [{}, {"chunk_rows": 2, "block_rows": 13}])
def test_ranking(spark, world, pieces):
    films, requests, reactions, plain = world
    prepared, rated = foldin.prepare_requests(requests), foldin.rated_films(reactions, films)
    vectors = foldin.solve(foldin.normal_equations(prepared, rated, films, tiers=TIERS), 10)
    got = foldin.rank_for_requests(vectors, films, rated, reach=REACH, **pieces).orderBy("reqId", "rank").collect()
    for request in REQUESTS:
        mine = [(r.movieId, round(r.score, 6)) for r in got if r.reqId == request[0]]
        assert mine == _ranking(plain, request)


def test_whole_path_and_candidate_counts(spark, world):
    films, requests, reactions, plain = world
    picks = foldin.recommend_for_requests(requests, reactions, films, reach=REACH, tiers=TIERS)
    ids = {}
    for r in picks.orderBy("reqId", "rank").collect():
        ids.setdefault(r.reqId, []).append(r.movieId)
    counts = {r.reqId: r.n_candidates for r in
              foldin.candidate_counts(foldin.prepare_requests(requests), films, REACH).collect()}
    for request in REQUESTS:
        assert ids.get(request[0], []) == [i for i, _ in _ranking(plain, request)]
        unrated = (request[0], request[1], request[2], request[3], {})
        assert counts[request[0]] == len(_ranking(plain, unrated, k=10**6))


def test_another_rank_from_end_to_end(spark, world):
    """Vectors of twenty values give twenty-value answers; one of another length stops the job."""
    films, requests, reactions, _ = world
    longer = films.withColumn("features", F.concat("features", F.transform("features", lambda x: x / 2)))
    prepared, rated = foldin.prepare_requests(requests), foldin.rated_films(reactions, longer)
    equations = foldin.normal_equations(prepared, rated, longer, tiers=TIERS)
    for r in foldin.solve(equations, 20).collect():
        assert len(r.gram) == 210 and len(r.rhs) == 20 and len(r.vector) == 20
    assert foldin.gram_cells(equations, 20).groupBy("reqId").count().filter("count <> 210").isEmpty()
    assert foldin.recommend_for_requests(requests, reactions, longer, reach=REACH, tiers=TIERS).count() > 0
    mixed = longer.withColumn("features", F.when(F.col("movieId") == 1, F.slice("features", 1, 10))
                              .otherwise(F.col("features")))
    with pytest.raises(Exception, match="expected vectors of 20 values"):
        foldin.rated_sums(rated, mixed, 20).collect()


def test_no_films_at_all(spark, world):
    films, requests, reactions, _ = world
    picks = foldin.recommend_for_requests(requests, reactions, films.limit(0), reach=REACH, tiers=TIERS)
    assert picks.count() == 0


def test_film_table_needs_ratings_and_a_vector(spark):
    ratings = spark.createDataFrame(
        [(u, m, 4 + u % 2, 0) for u in range(25) for m in (1, 2)] + [(u, 3, 5, 0) for u in range(19)],
        "userId int, movieId int, rating int, timestamp long")
    movies = spark.createDataFrame([(1, "A (1990)", "Drama|Odd"), (2, "B", ""), (3, "C", "War")],
                                   "movieId int, title string, genres string")
    factors = spark.createDataFrame([(1, [0.0015] * 10), (3, [1.0] * 10)], "id int, features array<double>")
    row, = films_op.film_table(ratings, movies, factors).collect()
    # mean 4.48 is kept as 45 tenths, 1.5 thousandths go to the even neighbour
    assert (row.movieId, row.year, row.mask, row.cnt, row.mean10, row.q) == (1, 1990, 1 << 7, 25, 45, [2] * 10)


def test_reactions_are_worked_out_once(spark, monkeypatch):
    """Films that count and pairs to fit start from one written table of reactions."""
    import __spark_entry__ as entry
    from conftest import SF_DIR
    from filmfold.plans import artifacts, queries

    calls, build = [], queries.V.request_reactions
    monkeypatch.setattr(queries.V, "request_reactions", lambda *args: calls.append(1) or build(*args))
    monkeypatch.setattr(artifacts, "_DONE", {})
    assert entry.queries()["genre_fit"](spark, SF_DIR).count() > 0
    assert len(calls) == 1
