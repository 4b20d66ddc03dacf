import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabel.functions.text import n_words
from textlabel.operators import describe, ranking


def test_freq_table_sorted_with_percent(spark):
    df = spark.createDataFrame([("b",)] * 2 + [("a",)] * 2 + [("c",)] + [(None,)], "county string")
    got = [tuple(r) for r in describe.freq_table(df, "county").collect()]
    assert got == [("a", 2, 33.3), ("b", 2, 33.3), (None, 1, 16.7), ("c", 1, 16.7)]


def test_pct_within_sums_to_hundred(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("x", 0), ("y", 1), (None, 1)], "name string, value int")
    got = describe.pct_within(df, "name", "value")
    assert {(r["name"], r["value"]): round(r["freq"], 4) for r in got.collect()} == {
        ("x", 1): 33.3333, ("x", 0): 66.6667, ("y", 1): 100.0, (None, 1): 100.0,
    }
    sums = got.groupBy("name").agg(F.sum("freq").alias("s")).collect()
    assert all(abs(r["s"] - 100) < 1e-9 for r in sums)


def test_unicode_word_count(spark):
    df = spark.createDataFrame([("été père 4-ANPP",)], "t string")
    assert df.select(n_words("t")).first()[0] == 4


def test_six_numbers(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 10]] + [(None,)], "v int")
    r = describe.six_num(df, "v").first()
    assert (r["min"], r["q1"], r["mean"], r["median"], r["q3"], r["max"]) == (1, 2.0, 4.0, 3.0, 4.0, 10)


@pytest.mark.parametrize("rows_per_bucket", [7, 1000])
def test_quantiles_equal_numpy(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    data = [float(x) for x in np.concatenate([rng.lognormal(0, 3, 150), np.repeat(1.5, 80)])]
    df = spark.createDataFrame([(x,) for x in data] + [(None,)] * 3, "v double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    row = ranking.quantile_table(df, "v", probs, rows_per_bucket=rows_per_bucket).first()
    assert np.allclose(row["q"], np.quantile(data, probs))
    assert (row["n"], row["missing"]) == (230, 3)


def test_quantiles_type2(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 9)], "v double")
    assert ranking.quantile_table(df, "v", [0.25, 0.5, 1.0], type2=True).first()["q"] == [2.5, 4.5, 8.0]


@pytest.mark.parametrize("rows_per_bucket", [5, 1000])
def test_running_totals(spark, rows_per_bucket):
    df = spark.range(60).select(
        F.when(F.col("id") < 50, "big").otherwise("small").alias("g"), (F.col("id") * 1.5).alias("o"), F.lit(2).alias("m")
    )
    out = ranking.running_totals(df, "o", ["m"], ["g"], rows_per_bucket)
    got = {(r["g"], r["o"]): r["cum_m"] for r in out.collect()}
    assert got == {("big" if i < 50 else "small", i * 1.5): 2 * (i + 1 if i < 50 else i - 49) for i in range(60)}


def test_summary_table_counts_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "c string, x double")
    got = {(r["variable"], r["level"]): r for r in describe.summary_table(df, ["c"], ["x"]).collect()}
    assert got[("c", "a")]["n"] == 2 and abs(got[("c", "a")]["pct"] - 200 / 3) < 1e-9 and got[("c", "a")]["missing"] == 1
    x = got[("x", None)]
    assert (x["median"], x["q1"], x["q3"], x["missing"], x["n"]) == (3.0, 2.0, 4.0, 1, 3)


def test_cooccurrence_symmetric_with_marginals(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (0, 1, None)], "`a.x` int, b int, c int")
    got = {r["name"]: r.asDict() for r in describe.cooccurrence(df, ["a.x", "b", "c"]).collect()}
    assert got["a.x"]["a.x"] == 2 and got["b"]["b"] == 2 and got["a.x"]["b"] == got["b"]["a.x"] == 1
    assert got["c"]["c"] == 0 and got["c"]["n_null"] == 1


def test_indicators(spark, rows):
    df = spark.createDataFrame([(1, 0, 1), (1, 0, None), (0, 0, 1)], "`A B` int, z int, c int")
    assert rows(describe.prevalence(df, ["A B", "z", "c"])) == [("A B", 2), ("c", 2)]
    pct = {r["name"]: round(r["freq"], 3) for r in describe.indicator_pct(df, ["A B", "c"]).collect()}
    assert pct == {"A B": 66.667, "c": 66.667}
    assert rows(describe.positives_per_record(df, ["A B", "z", "c"])) == [(1, 2), (2, 1)]
    assert describe.indicator_long(df, ["A B", "z", "c"]).count() == 9


def test_uncount_also_for_heavy_rows(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 0), ("c", 1), ("d", None)], "k string, n int")
    got = {r["k"]: r["count"] for r in describe.uncount(df, "n").groupBy("k").count().collect()}
    assert got == {"a": 25_001, "c": 1}


def test_histogram(spark, rows):
    df = spark.createDataFrame([(0, "x"), (9, "x"), (10, "y")], "v int, g string")
    assert rows(describe.histogram(df, "v", 10, "g")) == [("x", 0, 2), ("y", 10, 1)]


def test_pivots(spark, rows):
    long = spark.createDataFrame([("o", "f", 1.0, 2.0), ("o", "g", 3.0, 4.0)], "outcome string, metric string, a double, b double")
    wide = describe.pivot_multi(long, ["outcome"], ["f", "g"], ["a", "b"])
    assert set(wide.columns) == {"outcome", "a_f", "a_g", "b_f", "b_g"}
    assert describe.pivot_metrics(long, ["outcome"], ["f", "g"], "a").first().asDict() == {"outcome": "o", "f": 1.0, "g": 3.0}
    assert describe.pivot_multi(long, ["outcome"], ["f"], ["a"]).columns == ["outcome", "a_f"]


def test_top_n_keeps_ties(spark):
    data = [(float(max(i, 8)), "p", i) for i in range(20)] + [(1.0, "n", 99)]
    df = spark.createDataFrame(data, "importance double, sign string, id int")
    got = ranking.top_n(df, "sign", "importance", 12)
    assert got.filter("sign = 'p'").count() == 20  # nine rows tie at the twelfth place
    assert ranking.top_n(df, "sign", "importance", 11).filter("sign = 'p'").count() == 11
    assert got.filter("sign = 'n'").count() == 1
