"""Every ledger query against its DuckDB SQL: columns, types and rows."""

import pytest
from compare import duck, duck_rows, kinds_differ, spark_rows

from ledgerloom.oracles import ORACLES
from ledgerloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert not kinds_differ(df, con, ORACLES[name])
    assert spark_rows(df) == duck_rows(con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["category", "actual_cents", "average_cents", "difference_cents", "percent_bp", "signal", "seasonal"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_period_reaches_the_scan(spark):
    """A month's totals push the date bounds down and read the needed columns alone."""
    plan = QUERIES["totals_by_category"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "lineitem.parquet" in x)
    assert "GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line
    assert "l_comment" not in line and "l_linestatus" not in line
