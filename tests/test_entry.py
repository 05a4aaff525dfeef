import os

import pytest

import __spark_entry__ as entry
from tessera.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values())
    # Queries without SQL: fitted models.
    assert set(QUERIES) - set(sql) == {"kmeans_groups", "run_benchmark"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the supplied tables")
def test_entry_and_pushdown(spark):
    df = entry.entry(spark)
    assert df.count() == 5
    plan = entry.queries()["filter_eq"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan
    top = entry.queries()["top_n"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top and "Partial" in top
