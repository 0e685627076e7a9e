import pytest
from annalist.plans import records  # noqa: F401  adds its queries
from annalist.plans.slate import ORACLE_SQL, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["q01_month_calendar"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
