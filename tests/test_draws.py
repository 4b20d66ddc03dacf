"""Replicates of exactly n draws: sums, marginals, independence of partitions, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabel.operators import draws


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(3000).select("id", (F.col("id") % 7).alias("v"))


def weights(df, id_col="id"):
    return {r[id_col]: r["weights"] for r in df.collect()}


def test_every_replicate_has_n_draws_and_marginals_are_right(table):
    got = weights(draws.exact_weights(table, "id", 400))
    w = np.array([got[i] for i in range(3000)])
    assert w.shape == (3000, 400) and (w.sum(0) == 3000).all()
    # Weights are Binomial(n, 1 / n); the means of two halves of the rows sway against each other.
    assert abs((w == 0).mean() - (1 - 1 / 3000) ** 3000) < 0.002 and abs(w.var() - (1 - 1 / 3000)) < 0.01
    assert abs(w.mean(1).var() - 1 / 400) < 3e-4
    half = w[:1500].sum(0)
    assert abs(half.mean() - 1500) < 6 and 0.8 < half.var() / 750 < 1.25
    assert abs(np.corrcoef(w[:200])[np.triu_indices(200, 1)].mean()) < 0.005


def test_weights_depend_on_seed_and_ids_alone(table):
    one = weights(draws.exact_weights(table, "id", 20))
    assert one == weights(draws.exact_weights(table.repartition(7, "v"), "id", 20))
    assert one != weights(draws.exact_weights(table, "id", 20, seed=7))


def test_rows_of_one_id_and_null(spark):
    rows = [(None, i % 5, {"a": i}) for i in range(700)] + [(1, None, None)]
    df = spark.createDataFrame(rows, "id int, v int, extra map<string,int>").repartition(3)
    got = draws.exact_weights(df, "id", 50).collect()
    assert len(got) == 701 and (np.sum([r["weights"] for r in got], 0) == 701).all()
    # 700 rows of one hash are halved by place: no row gets them all.
    assert max(max(r["weights"]) for r in got) < 10


def test_sums(table):
    drawn = draws.exact_weights(table, "id", 30).persist()
    got = {r["replicate"]: (r["n"], r["v"]) for r in draws.weighted_sums(drawn, ["v"], 30).collect()}
    rows = drawn.collect()
    assert got == {k + 1: (3000, float(sum(r["v"] * r["weights"][k] for r in rows))) for k in range(30)}
    drawn.unpersist()


def test_empty_table_and_clashing_name(table):
    empty = draws.exact_weights(table.limit(0), "id", 5)
    assert empty.count() == 0 and empty.columns == ["id", "v", "weights"]
    assert [tuple(r) for r in draws.weighted_sums(empty, ["v"], 2).sort("replicate").collect()] == [(1, 0, 0.0), (2, 0, 0.0)]
    with pytest.raises(ValueError):
        draws.exact_weights(table.withColumn("weights", F.lit(1)), "id")
