"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

from skimdex import plans

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_query(spark, con, name):
    assert_same(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    assert set(plans.queries()) <= set(__spark_entry__.queries())
