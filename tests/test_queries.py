import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "n_name", "c_acctbal", "revenue"] and df.count() > 0


def test_every_counterpart_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", entry.queries())
def test_query_agrees_with_its_sql(spark, con, name):
    _, found, problem = compare(spark, con, SF, name)
    assert problem is None
    assert found or name == "tpch_q3_variant"
