import hashlib
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlabel.functions.hashing import POISSON_CUTS
from textlabel.operators import metrics, resample


@pytest.fixture(scope="module")
def people(spark):
    label = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 10 == 1, 1).otherwise(0)
    return spark.range(1000).withColumn("y", label)


def brute_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_split_is_exact_and_ignores_layout(people, rows):
    one = resample.stratified_split(people.coalesce(1), "id", "y", 0.8, 5)
    many = resample.stratified_split(people.repartition(7).orderBy(F.desc("id")), "id", "y", 0.8, 5, digits=1)
    assert rows(one) == rows(many)
    for y in (None, 0, 1):
        ids = [i for i in range(1000) if (None if i % 3 == 0 else int(i % 10 == 1)) == y]
        train = set(brute_order(ids, 5)[: math.floor(0.8 * len(ids))])
        part = one.filter(F.col("y").eqNullSafe(F.lit(y)))
        assert {r["id"] for r in part.filter("part = 'train'").collect()} == train
        assert part.filter("part = 'test'").count() == len(ids) - len(train)


@pytest.mark.parametrize("prop, train", [(0.0, 0), (1.0, 1000)])
def test_split_ends(people, prop, train):
    assert resample.stratified_split(people, "id", "y", prop).filter("part = 'train'").count() == train


def test_folds_partition_the_rows(people, rows):
    out = resample.stratified_folds(people, "id", "y", 10, 5)
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    sizes = out.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in sizes)
    assert rows(out) == rows(resample.stratified_folds(people.repartition(5), "id", "y", 10, 5, digits=2))


def test_bootstrap_weights(people):
    out = resample.bootstrap_weights(people.select("id"), "id", 20, seed=3, apparent=True)
    stats = out.filter("replicate > 0").agg(F.avg("weight").alias("m"), F.var_pop("weight").alias("v")).first()
    assert abs(stats["m"] - 1) < 0.05 and abs(stats["v"] - 1) < 0.1
    assert out.filter("replicate = 0 and weight <> 1").count() == 0 and out.count() == 21_000
    cuts, total = [], 0.0
    for k in range(len(POISSON_CUTS)):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    assert cuts == pytest.approx(POISSON_CUTS, abs=1e-12) and 1 - POISSON_CUTS[-1] < 2**-32


def test_class_metrics_by_hand(spark):
    conf = spark.createDataFrame([("a", 40, 10, 5, 45), ("none", 0, 0, 3, 0)], "outcome string, tp long, fp long, fn long, tn long")
    got = {r["outcome"]: r for r in metrics.class_metrics(conf).collect()}
    a = got["a"]
    assert math.isclose(a["f_meas"], 80 / 95) and math.isclose(a["accuracy"], 0.85) and math.isclose(a["kap"], 0.7)
    assert math.isclose(a["sens"], 40 / 45) and math.isclose(a["spec"], 45 / 55) and math.isclose(a["ppv"], 0.8)
    assert math.isclose(a["npv"], 0.9) and a["recall"] == a["sens"] and a["precision"] == a["ppv"]
    none = got["none"]
    assert none["sens"] == 0 and none["ppv"] is None and none["spec"] is None and none["accuracy"] == 0


def test_confusion_forms_agree(spark, rows):
    data = [(i, i % 2, int(i % 5 == 0)) for i in range(50)] + [(99, None, 1)]
    df = spark.createDataFrame(data, "id int, `t.x` int, e int")
    wide = metrics.confusion_wide(df, {"o": ("t.x", "e")})
    long = metrics.confusion(df.withColumn("outcome", F.lit("o")), "t.x", "e")
    assert rows(wide) == rows(long) == [("o", 5, 5, 20, 20)]


def auc_brute(scores, truth):
    pos = [s for s, t in zip(scores, truth) if t == 1]
    neg = [s for s, t in zip(scores, truth) if t == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=40), st.sampled_from([2, 1000]))
def test_auc_equals_pair_counting(spark, data, per_bucket):
    df = spark.createDataFrame([("o", s / 4, t) for s, t in data], "outcome string, p1 double, truth int")
    got = metrics.roc_auc(df, rows_per_bucket=per_bucket).first()["roc_auc"]
    want = auc_brute([s for s, _ in data], [t for _, t in data])
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize("per_bucket", [2, 1000])
def test_curves(spark, rows, per_bucket):
    data = [("o", s, t) for s, t in [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0)]] + [("p", 0.5, 0)]
    df = spark.createDataFrame(data, "outcome string, p1 double, truth int")
    roc = [tuple(r) for r in metrics.roc_curve(df, rows_per_bucket=per_bucket).filter("outcome = 'o'").orderBy("threshold").collect()]
    inf = float("inf")
    assert [(t, round(a, 4), round(b, 4)) for _, t, a, b in roc] == [
        (-inf, 0, 1), (0.1, 0, 1), (0.3, 0.3333, 1), (0.8, 0.6667, 1), (0.9, 1, 0.5), (inf, 1, 0),
    ]
    pr = [tuple(r) for r in metrics.pr_curve(df, rows_per_bucket=per_bucket).filter("outcome = 'o'").orderBy("threshold").collect()]
    assert [(t, r, round(p, 4)) for _, t, r, p in pr] == [
        (0.1, 1, 0.4), (0.3, 1, 0.5), (0.8, 1, 0.6667), (0.9, 0.5, 1), (inf, 0, 1),
    ]
    empty = metrics.roc_curve(df).filter("outcome = 'p' and threshold = 0.5").first()
    assert empty["sensitivity"] is None and empty["specificity"] == 0


def test_collect_and_interval_skip_null(spark):
    m = spark.createDataFrame([("o", "m", "c", "f", x) for x in (0.2, 0.4, None)], "outcome string, model string, config string, metric string, estimate double")
    r = metrics.collect_metrics(m).first()
    assert math.isclose(r["mean"], 0.3) and r["n"] == 2 and math.isclose(r["std_err"], 0.1)
    ci = metrics.bootstrap_ci(m).first()
    assert math.isclose(ci["ci_lower"], 0.205) and math.isclose(ci["ci_upper"], 0.395)


def test_bootstrap_forms_agree(spark, rows):
    df = spark.range(200).select(
        "id", F.lit("o").alias("outcome"), (F.col("id") % 2).cast("int").alias("truth"), (F.col("id") % 3 == 0).cast("int").alias("pred")
    )
    long = metrics.bootstrap_confusion(df, replicates=5)
    wide = metrics.bootstrap_confusion_wide(df, {"o": ("truth", "pred")}, replicates=5)
    cols = ["outcome", "replicate", "tp", "fp", "fn", "tn"]
    assert rows(long, *cols) == rows(wide, *cols)
    cells = metrics.bootstrap_confusion_cells(metrics.confusion(df), replicates=300)
    mean = cells.agg(*[F.avg(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).first()
    want = metrics.confusion(df).first()
    assert all(abs(mean[c] - want[c]) < 4 * math.sqrt(want[c] / 300) for c in ("tp", "fp", "fn", "tn"))
    assert rows(cells) == rows(metrics.bootstrap_confusion_cells(metrics.confusion(df.repartition(3)), replicates=300))
    assert np.isfinite(mean["tp"])
