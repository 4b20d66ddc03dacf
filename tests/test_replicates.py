"""Refits of all replicates at once against separate weighted fits."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlabel.operators import replicates, resample


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    table = []
    for i in range(150):
        x = rng.normal(size=4)
        table.append((i, x.tolist(), int(x[0] + rng.normal() > 0), None if i % 10 == 0 else int(rng.random() < 0.3)))
    return spark.createDataFrame(table, "id long, features array<double>, y int, z int").repartition(3)


def test_weights_equal_the_row_form(spark, rows):
    wide = {r.id: list(r.w) for r in rows.select("id", replicates.weight_array("id", 40, 7).alias("w")).collect()}
    for r in resample.bootstrap_weights(rows.select("id"), "id", 40, 7, apparent=True).collect():
        assert wide[r.id][r.replicate] == r.weight


def test_equal_to_separate_fits(rows):
    conf = {(r.outcome, r.replicate): r for r in replicates.refit_confusion(rows, "id", ["y", "z"], replicates=20).collect()}
    assert len(conf) == 42
    vectors = rows.withColumn("features", array_to_vector("features"))
    for outcome in ("y", "z"):
        known = vectors.filter(F.col(outcome).isNotNull()).withColumn("truth", F.col(outcome).cast("double"))
        for rep in (0, 1, 13):
            weight = F.lit(1.0) if rep == 0 else resample.weight_of(rep, "id").cast("double")
            drawn = known.withColumn("weight", weight)
            model = NaiveBayes(modelType="gaussian", labelCol="truth", weightCol="weight").fit(drawn.filter("weight > 0"))
            held = model.transform(drawn if rep == 0 else drawn.filter("weight = 0"))
            cells = held.groupBy().agg(*[F.sum(((F.col("truth") == t) & (F.col("prediction") == p)).cast("int")) for t, p in ((1, 1), (0, 1), (1, 0), (0, 0))]).first()
            r = conf[outcome, rep]
            assert (r.tp, r.fp, r.fn, r.tn) == tuple(cells)


def test_moments_missing_class_and_empty(spark, rows):
    model = replicates.fit_replicates(rows, "id", ["y"], replicates=3)
    got = {(r.truth, r.dim): (r.mean, r.variance) for r in model.table(rows).collect()}
    want = rows.groupBy("y").agg(F.avg(F.get("features", F.lit(2))).alias("m"), F.var_pop(F.get("features", F.lit(2))).alias("v")).collect()
    for r in want:
        assert got[r.y, 2] == pytest.approx((r.m, r.v))
    zeros = rows.withColumn("y", F.lit(0))
    assert {(r.tp, r.fp, r.fn) for r in replicates.refit_confusion(zeros, "id", ["y"], replicates=3).collect()} == {(0, 0, 0)}
    with pytest.raises(ValueError):
        replicates.fit_replicates(rows.limit(0), "id", ["y"])


def test_metrics_are_long(rows):
    m = replicates.refit_metrics(replicates.refit_confusion(rows, "id", ["y"], replicates=5))
    assert m.filter("metric = 'accuracy'").count() == 6
