import pytest

import residua.run_queries  # noqa: F401
from residua.queries import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)


def test_relational_mean_needs_no_join(spark, tmp_path):
    """Spark would take one side, a row for each value of each token, for small enough to broadcast; and a join pairs the places of rows that share a key."""
    rows = [(k, f"a ring {k}") for k in range(50)] + [(1, "bolt"), (1, "x" * 3000 + " A"), (None, "cold plate"), (60, "***")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    plan = QUERIES["mean_pooled_relational"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    same(spark, QUERIES["mean_pooled_relational"], ORACLE_SQL["mean_pooled_relational"], str(tmp_path))
