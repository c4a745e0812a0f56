import oracle
import pytest

from tidemark.llm import queries

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    oracle.compare(spark, queries.QUERIES[name], queries.SQL[name], oracle.connection())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(oracle.DATA))
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
