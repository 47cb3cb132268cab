"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, data, name):
    assert compare(spark, con, name, queries()[name], oracle_sql().get(name), data) is None


def test_entry_gives_rows(spark):
    assert 0 < entry(spark).count() <= 5


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
