import pytest
from oracle import DATA, connect, rows

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), connect().sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
