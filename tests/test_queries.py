import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import differences, duckdb_on

SF = "/root/testdata/sf0.001"

# one row of totals, or a rank over what a distributed top-k left
ONE_TASK = {"repo_rank_range", "final_metadata", "sample_preview"}


@pytest.fixture(scope="module")
def con():
    return duckdb_on(SF)


@pytest.mark.parametrize("name", sorted(set(queries()) & set(oracle_sql())))
def test_query_agrees_with_its_sql(spark, con, name):
    frame = queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan or name in ONE_TASK
    assert differences(frame, con, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).columns == ["instance_id", "fail_to_pass", "pass_to_pass"]
    assert entry(spark).where("fail_to_pass is not null or pass_to_pass is not null").count() > 0
