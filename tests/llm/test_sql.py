"""Text queries that SQL can say, against their SQL over the given tables."""

import pytest

from compare import connect, mismatch
from conftest import SF_DIR
from filmfold.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(spark, name):
    assert mismatch(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
