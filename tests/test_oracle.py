import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    rows, _, _, diff = compare(spark, con, sf_dir, name, entry.queries()[name], SQL[name])
    assert diff is None and rows > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SQL])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0
