import numpy as np
import pyarrow as pa
import pytest

from filmfold.operators import scoring


def _tables(spark, n_users, n_items, seed=0, rank=10, twins=True):
    rng = np.random.default_rng(seed)
    users, items = rng.random((n_users, rank)), rng.random((n_items, rank))
    if twins:  # equal vectors, so that ties decide
        items[n_items // 2:] = items[: n_items - n_items // 2]
    def frame(m):
        return spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(m)], "id int, features array<double>")
    return users, items, frame(users), frame(items)


def _exact(users, items):
    out = np.zeros((len(users), len(items)))
    for d in range(users.shape[1]):
        out += users[:, d, None] * items[None, :, d]
    return out


def _brute(users, items, k, excluded=frozenset()):
    scores, rows = _exact(users, items), set()
    for u in range(len(users)):
        order = sorted((-scores[u, i], i) for i in range(len(items)) if (u * 3, i * 3) not in excluded)
        rows |= {(u * 3, r + 1, i * 3, round(-s, 9)) for r, (s, i) in enumerate(order[:k])}
    return rows


def _rows(df):
    return {(r.userId, r["rank"], r.movieId, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("pieces", [{}, {"chunk_rows": 7, "block_rows": 11}, {"block_rows": 1}])
def test_top_k_is_exact_for_any_cut(spark, pieces):
    users, items, uf, vf = _tables(spark, 23, 40)
    assert _rows(scoring.top_k_per_user(uf, vf, 6, **pieces)) == _brute(users, items, 6)


def test_k_above_the_number_of_items(spark):
    users, items, uf, vf = _tables(spark, 3, 4)
    assert _rows(scoring.top_k_per_user(uf, vf, 10, block_rows=3)) == _brute(users, items, 10)


def test_zero_vectors_tie_on_the_lower_id(spark):
    _, items, _, vf = _tables(spark, 1, 30)
    zero = spark.createDataFrame([(0, [0.0] * 10)], "id int, features array<double>")
    got = scoring.top_k_per_user(zero, vf, 4, block_rows=9)
    assert sorted(r.movieId for r in got.collect()) == [0, 3, 6, 9]


def test_excluded_pairs_leave_room_for_others(spark):
    users, items, uf, vf = _tables(spark, 9, 25)
    gone = {(u * 3, i * 3) for u in range(9) for i in range(25) if (u + i) % 2 == 0 or u == 4}
    gone |= {(0, 999), (500, 3)}  # unknown film, unknown user
    pairs = spark.createDataFrame(sorted(gone) * 2, "userId int, movieId int")
    got = scoring.top_k_per_user(uf, vf, 5, excluded=pairs, chunk_rows=4, block_rows=6)
    assert _rows(got) == _brute(users, items, 5, gone)
    assert not got.filter("userId = 12").count()  # every film excluded


def test_empty_sides(spark):
    _, _, uf, vf = _tables(spark, 3, 4)
    assert scoring.top_k_per_user(uf.limit(0), vf, 3).count() == 0
    assert scoring.top_k_per_user(uf, vf.limit(0), 3).count() == 0


def test_score_pairs_drops_unknown_ids(spark):
    users, items, uf, vf = _tables(spark, 3, 4)
    pairs = spark.createDataFrame([(0, 3), (3, 9), (1, 3), (0, 1)], "userId int, movieId int")
    got = {(r.userId, r.movieId): r.score for r in scoring.score_pairs(pairs, uf, vf).collect()}
    assert got == pytest.approx({(0, 3): users[0] @ items[1], (3, 9): users[1] @ items[3]})


def test_cuts_follow_the_rows(spark):
    few, many = spark.range(500), spark.range(100_000)
    assert scoring.pieces(few, 1000) == 1 and scoring.pieces(many, 1000) == 100
    assert scoring.pieces(few, 1000, at_least=8) == 1 and scoring.pieces(many, 10**6, at_least=8) == 8


def test_model_blocks_follow_the_ratings(spark, monkeypatch):
    from filmfold.operators import model

    cores = spark.sparkContext.defaultParallelism
    assert model.block_count(spark.range(10)) == cores
    monkeypatch.setattr(model, "BLOCK_ROWS", 100)
    assert model.block_count(spark.range(100 * (cores + 3))) == cores + 3


def test_blocks_do_not_follow_the_cores_where_ratings_are_many(spark, monkeypatch):
    from filmfold.operators import model

    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(model, "COPIES", 100)
    assert model.block_count(spark.range(100)) == min(cores, model.FEW_BLOCKS)
    monkeypatch.setattr(model, "BLOCK_ROWS", 10)
    assert model.block_count(spark.range(100)) == 10


def test_shuffle_files_of_few_iterations_lie_on_disk(spark):
    from filmfold.operators import model

    assert model.estimator(spark).getCheckpointInterval() <= 2


def test_only_films_that_can_reach_a_list_are_ranked(monkeypatch):
    """Past the first slice, films meet each user's bar and no order of all of them is made."""
    rng = np.random.default_rng(3)
    users, items = rng.random((50, 6)), rng.random((20_000, 6))
    items[:10_000] = items[10_000:]  # ties across slices
    vectors = [pa.array(m.tolist(), pa.list_(pa.float64())) for m in (users, items)]
    queries = pa.table({"qid": np.arange(50) * 3, "vector": vectors[0], "excluded": pa.nulls(50, pa.list_(pa.int64()))})
    films = pa.table({"id": np.arange(20_000) * 3, "vector": vectors[1]})
    cells, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kwargs: cells.append(a.size) or partition(a, *args, **kwargs))
    got = scoring._block_scorer(7, False, 1.0)(queries, films).to_pylist()
    assert sum(cells) <= 50 * 4096
    want = {(u, i, s) for u, _, i, s in _brute(users, items, 7)}
    assert len(got) == 350 and {(r["qid"], r["id"], round(r["score"], 9)) for r in got} == want


def test_each_group_has_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 24, 336):
        keys = scoring.slot_keys(n)
        table = spark.createDataFrame([(k,) for k in keys], "k int")
        assert [r[0] for r in table.select(F.pmod(F.hash("k"), F.lit(n))).collect()] == list(range(n))


@pytest.mark.parametrize("spread", [0.0, 6.0])
def test_longest_vectors_settle_most_lists(spark, monkeypatch, spread):
    """With lengths that differ much, few users or none meet the rest of the films; lists are those of all pairs."""
    rng = np.random.default_rng(5)
    users, items = rng.normal(size=(60, 5)), rng.normal(size=(400, 5))
    if spread > 2:
        users, items = np.abs(users), np.abs(items)
    users[1] = 0  # ties with every film
    items /= np.sqrt((items * items).sum(axis=1))[:, None]
    items *= np.exp(spread * rng.random((400, 1)))
    items[200:] = items[:200]
    def frame(m):
        return spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(m)], "id int, features array<double>")
    pairs, scored = [], scoring._scored
    monkeypatch.setattr(scoring, "_scored", lambda q, i, *a, **kw: pairs.append(q.count() * i.count()) or scored(q, i, *a, **kw))
    got = scoring.top_k_per_user(frame(users), frame(items), 6, head_rows=150, chunk_rows=40, block_rows=250)
    assert _rows(got) == _brute(users, items, 6)
    if spread > 2:
        assert sum(pairs) < 0.6 * 60 * 400


def test_longest_first_with_repeated_ids_and_few_films(spark):
    users, items, uf, vf = _tables(spark, 12, 30)
    for k in (4, 40):
        both = [scoring.top_k_per_user(uf.union(uf.filter("id < 9")), vf.union(vf.filter("id > 60")), k, **cut)
                for cut in ({"head_rows": 5}, {})]
        assert both[0].exceptAll(both[1]).isEmpty() and both[0].count() == both[1].count()
