import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import queries  # noqa: E402
from tests.oracle_compare import compare, connect  # noqa: E402


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    rows, _, _, diff = compare(spark, connect(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert diff is None and rows > 0
