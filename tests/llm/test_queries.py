import pytest

from residua.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and "doc_id" in df.columns
    df.count()
