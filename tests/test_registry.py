"""The registered queries against their SQL on the smallest tables, and with one shuffle partition."""

import pytest

import __spark_entry__ as registry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    result = compare(registry.queries()[name](spark, SF), con, SQL[name])
    spark.catalog.clearCache()
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", ["keyword_metrics", "tfidf", "event_folds", "roc_curve", "order_summary_table", "collapse_concepts"])
def test_one_shuffle_partition(spark, con, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert compare(registry.queries()[name](spark, SF), con, SQL[name]).startswith("ok")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[0] == "substance" and df.count() == 9
