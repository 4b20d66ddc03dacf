import pytest
from pyspark.sql import functions as F

from textlabel.operators import joins


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows share one key; some keys are NULL or unknown."""
    key = F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(900).withColumn("key", key)


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 50, 2)], "key string, x double")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_lookup_join_equals_plain_join(spark, rows, skewed, lookup, how, max_bytes):
    got = joins.lookup_join(skewed, lookup, "key", how, max_bytes=max_bytes)
    want = skewed.join(lookup, "key", how)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_null_safe_lookup(spark, skewed, max_bytes):
    lookup = spark.createDataFrame([(None, 5.0), ("hot", 1.0)], "key string, x double")
    got = joins.lookup_join(skewed, lookup, "key", "inner", max_bytes=max_bytes, null_safe=True)
    assert got.filter("x = 5").count() == skewed.filter("key is null").count() > 0


def test_large_lookup_is_not_broadcast(spark, skewed, lookup):
    plan = joins.lookup_join(skewed, lookup, "key", "left", max_bytes=0)
    spread = plan.groupBy(F.spark_partition_id()).count()
    assert spread.count() > 1
    assert joins.measured_bytes(lookup) > 26 * 20


def test_error_analysis(spark, rows):
    pred = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (9, 0, 1)], "id int, truth int, pred int")
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, text string, n int")
    assert rows(joins.error_analysis(pred, docs), "id", "error", "text") == [(1, 1, "a"), (2, 0, "b"), (9, 1, None)]
    assert set(joins.error_analysis(pred, docs, cols=None).columns) == {"id", "truth", "pred", "error", "text", "n"}


def test_natural_join_cross_and_union(spark, rows):
    a = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "id int, k string, n int")
    b = spark.createDataFrame([(1, "x", 7), (2, "z", 8)], "id int, k string, m int")
    assert rows(joins.natural_left_join(a, b)) == [(1, "x", 2, 7), (2, "y", 3, None)]
    with pytest.raises(ValueError):
        joins.natural_left_join(a.select("n"), b)
    assert joins.cross(a, "model", ["p", "q", "r"]).count() == 6
    both = joins.union_all([a, b])
    assert both.columns == ["id", "k", "n", "m"] and both.count() == 4
