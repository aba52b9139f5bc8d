import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmfold.operators import als, model
from filmfold.session import scratch_path

RATED = "userId int, movieId int, rating float"


def _ratings(n_users=40, n_films=60, seed=1):
    """Ids far apart and below zero, a user and a film with most of the ratings, pairs that come twice."""
    rng = random.Random(seed)
    rows = [(rng.randrange(n_users) * 37 - 200, rng.randrange(n_films) * 1_000_003 - 5, float(rng.randrange(1, 6))) for _ in range(600)]
    rows += [(-200, rng.randrange(n_films) * 1_000_003 - 5, 4.0) for _ in range(300)]
    return rows + [(rng.randrange(n_users) * 37 - 200, -5, 2.0) for _ in range(300)] + rows[:50]


def _solved(gram, rhs):
    """One non-negative solve by every choice of the entries that are free."""
    k, best = len(rhs), None
    for choice in range(2**k):
        on = np.array([choice >> i & 1 for i in range(k)], bool)
        x = np.zeros(k)
        x[on] = np.linalg.solve(gram[np.ix_(on, on)], rhs[on])
        value = x @ gram @ x / 2 - rhs @ x
        if (x >= 0).all() and (best is None or value < best[0]):
            best = value, x
    return best[1]


def _plain(rows, rank, reg, iterations, seed):
    """The same fit, one user or film after another."""
    users, films = (sorted({r[i] for r in rows}) for i in (0, 1))
    u = dict(zip(users, als.first_vectors(np.array(users, np.int32), rank, seed)))
    v = {}
    for _ in range(iterations):
        for mine, own, other, at in ((films, v, u, 1), (users, u, v, 0)):
            for key in mine:
                some = [(other[r[1 - at]].astype(float), r[2]) for r in rows if r[at] == key]
                m, s = np.array([a for a, _ in some]), np.array([b for _, b in some])
                own[key] = _solved(m.T @ m + reg * len(some) * np.eye(rank), m.T @ s).astype(np.float32)
    return u, v


@pytest.mark.parametrize("blocks", [1, 3])
def test_factors_are_those_of_a_plain_fit_for_any_blocks(spark, monkeypatch, blocks):
    for name, value in (("CHUNK", 7), ("PART", 50), ("CELLS", 100), ("POOL", 4)):
        monkeypatch.setattr(als, name, value)
    rows = _ratings()
    sides = als.prepare(spark.createDataFrame(rows, RATED), blocks)
    found = als.fit(*sides, 3, 0.05, 2, 42)
    als.release(*sides)
    for table, want in zip(found, _plain(rows, 3, 0.05, 2, 42)):
        got = {r.id: np.array(r.features) for r in table.collect()}
        assert got.keys() == want.keys() and table.count() == len(want)
        assert all(got[i] == pytest.approx(want[i], rel=1e-4, abs=1e-5) for i in want)


@pytest.mark.parametrize("rank", [1, 5, 8])
def test_non_negative_solves(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(300, 12, rank)) * (rng.random((300, 1, rank)) < 0.9)
    gram = a.transpose(0, 2, 1) @ a + 1e-3 * np.eye(rank)
    rhs = rng.normal(size=(300, rank))
    rhs[:9] = 0
    got = als.non_negative(gram, rhs)
    assert all(got[i] == pytest.approx(_solved(gram[i], rhs[i]), abs=1e-7) for i in range(300))


def test_an_iteration_shuffles_nothing_and_has_a_task_for_each_block(spark):
    sides = als.prepare(spark.createDataFrame(_ratings(), RATED), 5)
    step = als._one_task_each(sides[0].blocks, sides[1].ids, als._half(3, 0.1, sides[1].first), als.PACKED)
    assert step.rdd.getNumPartitions() == 5
    assert "Exchange" not in step._jdf.queryExecution().executedPlan().toString()
    als.release(*sides)


def test_many_ratings_are_fitted_in_blocks_with_as_small_an_error(spark, monkeypatch):
    rows = [(u, m, 1.0 + (u * m) % 5) for u in range(60) for m in range(50) if (u + m) % 3]
    ratings = spark.createDataFrame(rows, RATED)
    small = model.train(ratings, rank=4, max_iter=6)
    monkeypatch.setattr(model, "MLLIB_ROWS", 0)
    monkeypatch.setattr(model, "block_count", None)  # MLlib's blocks are not asked for
    monkeypatch.setattr(als, "block_count", lambda cores, rows: 2)
    many = model.train(ratings, rank=4, max_iter=6)
    errors = [model.rmse(model.predict(m, ratings)).first().rmse for m in (small, many)]
    assert errors[1] <= 1.05 * errors[0]
    path = scratch_path(spark, "als-kept")
    model.save(many, path)
    again = model.load(path)
    assert (again.rank, again.getOrDefault("coldStartStrategy"), again.getUserCol()) == (4, "drop", "userId")
    assert {r.side: (r.n_factors, r.n_bad_length, r.n_negative) for r in model.factor_summary(again).collect()} == {
        "user": (60, 0, 0), "item": (50, 0, 0)}
    configs, packed, prepare = [(2, 0.1, 1), (3, 0.1, 1)], [], als.prepare
    monkeypatch.setattr(als, "prepare", lambda *a: packed.append(prepare(*a)) or packed[-1])
    tuned = model.tuned_models(ratings, configs)
    assert len(packed) == 1  # settings share the blocks, in files
    assert [(c, m.rank) for c, m in tuned] == [(c, c[0]) for c in configs]
    assert [r.is_best for r in model.tune(tuned, ratings).collect()].count(True) == 1


def test_ids_and_stars_that_mllib_refuses_are_refused(spark):
    for row in ((None, 1, 2.0), (1, None, 2.0), (1, 2, None), (1, 2, float("nan")), (2**31, 1, 2.0)):
        with pytest.raises(Exception, match="userId|movieId|rating"):
            als.checked(spark.createDataFrame([row], "userId long, movieId long, rating float")).collect()
    kept = als.checked(spark.createDataFrame([(2**31 - 1, -2**31, 2)], "userId long, movieId long, rating int"))
    assert kept.dtypes == [("userId", "int"), ("movieId", "int"), ("rating", "float")] and kept.count() == 1
