"""Quality of lists against plain computations, implicit feedback, and fits side by side."""

import math
import random
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filmfold.operators import implicit, model, ranking

RATED = "userId long, movieId long, rating int"
LISTS = "userId long, movieId long, rank int"


def _plain(lists, held, k, least):
    gains = defaultdict(dict)
    for user, film, stars in held:
        if stars >= least:
            gains[user][film] = max(gains[user].get(film, 0), 2 ** stars - 1)
    out = {}
    for user, films in gains.items():
        hits = [(rank, films[film]) for u, film, rank in lists if u == user and rank <= k and film in films]
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(films.values(), reverse=True)[:k]))
        out[user] = (len(films), len(hits), len(hits) / k, len(hits) / len(films), sum(g / math.log2(r + 1) for r, g in hits) / ideal)
    return out


def test_hand_case(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], LISTS)
    held = spark.createDataFrame([(1, 11, 5), (1, 12, 4), (1, 99, 4), (1, 10, 2), (3, 10, 5)], RATED)
    rows = {r.userId: r for r in ranking.user_metrics(lists, held, k=2).collect()}
    assert set(rows) == {1, 3}  # user 2 has nothing held out
    assert (rows[1].n_relevant, rows[1].n_hits, rows[1].precision) == (3, 1, 0.5)
    assert rows[1].recall == pytest.approx(1 / 3) and rows[1].ndcg == pytest.approx((31 / math.log2(3)) / (31 + 15 / math.log2(3)))
    assert tuple(rows[3])[1:] == (1, 0, 0.0, 0.0, 0.0)
    mean = ranking.mean_metrics(ranking.user_metrics(lists, held, k=2)).first()
    assert (mean.n_users, mean.n_users_hit, mean.precision) == (2, 1, 0.25)


@pytest.mark.parametrize("k, least", [(1, 4), (10, 3), (50, 5)])
def test_random_lists(spark, k, least):
    rng = random.Random(k)
    lists = [(u, f, r + 1) for u in range(40) for r, f in enumerate(rng.sample(range(60), 20))]
    held = [(7 if rng.random() < 0.3 else rng.randrange(45), rng.randrange(60), rng.randrange(1, 6)) for _ in range(900)]
    got = ranking.user_metrics(spark.createDataFrame(lists, LISTS), spark.createDataFrame(held, RATED), k, least).collect()
    expected = _plain(lists, held, k, least)
    assert {r.userId for r in got} == set(expected)
    for r in got:
        assert tuple(r)[1:3] == expected[r.userId][:2] and tuple(r)[3:] == pytest.approx(expected[r.userId][2:])


def test_perfect_lists_gain_everything(spark):
    held = spark.createDataFrame([(1, f, s) for f, s in [(1, 5), (2, 5), (3, 4)]], RATED)
    lists = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 3, 3)], LISTS)
    assert ranking.user_metrics(lists, held, k=3).first().ndcg == pytest.approx(1.0)


def test_exposure(spark):
    movies = spark.range(1, 5).withColumnRenamed("id", "movieId")

    def found(times):
        shown = [(u, f, 1) for f, n in times.items() for u in range(n)]
        return ranking.exposure(spark.createDataFrame(shown, LISTS), movies).first()

    even, one, mixed = found({1: 3, 2: 3, 3: 3, 4: 3}), found({2: 8}), found({1: 1, 2: 2, 3: 5})
    assert (even.coverage, even.gini) == (1.0, pytest.approx(0.0)) and (one.n_shown, one.coverage, one.gini) == (1, 0.25, 0.75)
    values = [0, 1, 2, 5]
    plain = sum(abs(a - b) for a in values for b in values) / (2 * 4 * sum(values))
    assert (mixed.n_films, mixed.n_slots) == (4, 8) and mixed.gini == pytest.approx(plain)
    nothing = found({})
    assert (nothing.n_shown, nothing.coverage, nothing.gini) == (0, 0.0, None)


def test_novelty(spark):
    ratings = spark.createDataFrame([(u, 1, 3) for u in range(8)] + [(0, 2, 5), (1, 2, 5), (1, 2, 4), (0, 3, 1)], RATED)
    bits = {r.movieId: r.bits for r in ranking.self_information(ratings).collect()}
    assert bits == {1: 0.0, 2: 2.0, 3: 3.0}
    lists = spark.createDataFrame([(5, 1, 1), (5, 3, 2), (6, 9, 1)], LISTS)
    rows = {r.userId: tuple(r)[1:] for r in ranking.list_novelty(lists, ranking.self_information(ratings)).collect()}
    assert rows == {5: (2, 0, 1.5), 6: (1, 1, None)}


def test_counts_of_events(spark):
    rows = [(1, 5, "view"), (1, 5, "view"), (1, 5, "purchase"), (1, 6, "error"), (None, 5, "view"), (2, None, "click"), (2, 7, "click")]
    found = implicit.confidence(implicit.counted(spark.createDataFrame(rows, "userId long, movieId long, event_type string")), 2.0)
    assert sorted(map(tuple, found.collect())) == [(1, 5, 6.0, 1, 13.0), (2, 7, 2.0, 1, 5.0)]


def test_implicit_model_finds_groups(spark):
    """Two groups of users with items of their own: lists hold the group's items that a user has not met yet."""
    rng = random.Random(1)
    pairs = {(u, (u % 2) * 20 + rng.randrange(20)) for u in range(60) for _ in range(12)}
    counts = spark.createDataFrame([(u, i, 1.0 + rng.randrange(4)) for u, i in sorted(pairs)], "userId long, movieId long, rating double")
    fitted = implicit.train(counts, rank=4, max_iter=8, blocks=2)
    assert fitted.rank == 4 and model.factor_summary(fitted).agg(F.sum("n_negative")).first()[0] == 0
    hidden = spark.createDataFrame([(u, (u % 2) * 20 + i, 1) for u in range(60) for i in range(20) if (u, (u % 2) * 20 + i) not in pairs], RATED)
    from filmfold.operators import recommend
    picks = recommend.exclude_rated(recommend.picks_from_model(fitted, k=20), counts)
    mean = ranking.mean_metrics(ranking.user_metrics(ranking.renumbered(picks), hidden, k=3, relevant_from=1)).first()
    assert mean.precision > 0.9


def test_fits_run_side_by_side(spark):
    rng = random.Random(2)
    ratings = spark.createDataFrame([(rng.randrange(80), rng.randrange(90), rng.randrange(1, 6)) for _ in range(3000)], RATED)
    configs = [(2, 0.1, 6), (3, 0.1, 6), (4, 0.1, 6)]
    most, done, result = [0], threading.Event(), {}

    def watch():
        tracker = spark.sparkContext.statusTracker()
        while not done.is_set():
            most[0] = max(most[0], len(tracker.getActiveJobsIds()))
            time.sleep(0.002)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        result["side by side"] = model.tuned_models(ratings, configs, parallel=3)
    finally:
        done.set()
        watcher.join()
    assert most[0] >= 3
    result["in turn"] = model.tuned_models(ratings, configs, parallel=1)
    for (a, one), (b, other) in zip(*result.values()):
        assert a == b and one.rank == other.rank == a[0]
        vectors = [dict(map(tuple, m.userFactors.collect())) for m in (one, other)]
        assert all(vectors[0][u] == pytest.approx(vectors[1][u], rel=1e-4, abs=1e-5) for u in vectors[0])
