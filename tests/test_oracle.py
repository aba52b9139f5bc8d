"""Every registered query against its SQL over the same tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, mismatch
from conftest import SF_DIR
from filmfold.plans import oracle, queries as registry

QUERIES, SQL = registry.QUERIES, oracle.all_statements()
FOLD_IN = ["gram_matrix", "gram_rhs", "genre_affinity", "mood_rank"]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_registry_holds_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", FOLD_IN)
def test_fold_in_at_the_size_of_the_check(spark, name):
    larger = "/root/testdata/sf0.01"
    assert mismatch(QUERIES[name](spark, larger), connect(larger), SQL[name]) is None


def test_comparison_sees_a_millionth(spark, con):
    wrong = SQL["gram_rhs"].replace("AS value\n", "+ CASE WHEN w.reqId = 1 AND s.a = 0 THEN 1e-6 ELSE 0 END AS value\n")
    assert wrong != SQL["gram_rhs"]
    assert mismatch(QUERIES["gram_rhs"](spark, SF_DIR), con, wrong) is not None


def test_comparison_sees_a_difference(spark, con):
    wrong = SQL["rating_histogram"].replace("count(*) AS n", "count(*) + 1 AS n")
    assert mismatch(QUERIES["rating_histogram"](spark, SF_DIR), con, wrong) is not None


def test_entry_answers_every_customer(spark):
    answers = entry.entry(spark)
    assert answers.columns == ["userId", "type", "rank", "movieId", "title", "genres", "predictedRating"]
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert answers.select("userId").distinct().count() == customers
