"""Inputs that used to overflow, raise or give another result above some size."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlabel.functions.hashing import POISSON_CUTS
from textlabel.functions.text import has_any, tokenize
from textlabel.operators import concepts, describe, features, joins, metrics, ranking, recode
from textlabel.plans import models, tune

DOTTED = "a." * 100_000 + "b"
LEXICON = "alias string, entity string, cui string, semantic_type string"


def test_long_dotted_text(spark):
    df = spark.createDataFrame([(1, DOTTED), (2, "1,000 and 2,500.75 a,b 3,x x1,2")], "id int, text string").repartition(1)
    got = {r.id: r.t for r in df.select("id", tokenize("text").alias("t")).collect()}
    assert len(got[1]) == 1 and len(got[1][0]) == len(DOTTED)
    assert got[2] == ["1,000", "and", "2,500.75", "a", "b", "3", "x", "x1", "2"]
    model = features.TfidfRecipe(min_times=1, max_tokens=5, stop=()).fit(df)
    assert model.transform(df).count() == 2
    lexicon = spark.createDataFrame([("and", "and", "C1", "T")], LEXICON)
    assert concepts.annotate(df, lexicon).count() == 1


def test_keywords_of_any_script_fold_case(spark):
    df = spark.createDataFrame([("ÉTION",), ("étion",), ("etion",), ("СТРОКА",)], "text string")
    assert [r.x for r in df.select(has_any("text", ["étion", "строка"]).alias("x")).collect()] == [1, 1, 0, 1]


def test_any_number_of_alias_lengths(spark):
    aliases = [(" ".join(f"w{j}" for j in range(n)), f"e{n}", f"C{n}", "T") for n in range(1, 41)]
    text = " ".join(f"w{j}" for j in range(40))
    df = spark.createDataFrame([(1, text), (2, "w0"), (3, ""), (4, None)], "id int, text string")
    for count in (3, 40):
        got = concepts.annotate(df, spark.createDataFrame(aliases[:count], LEXICON)).groupBy("id").count().collect()
        assert {r["id"]: r["count"] for r in got} == {1: count, 2: 1}


def test_poisson_weights_have_mean_and_variance_one():
    edges = [0.0, *POISSON_CUTS, 1.0]
    probabilities = [max(0.0, b - a) for a, b in zip(edges, edges[1:])]
    mean = sum(k * p for k, p in enumerate(probabilities))
    variance = sum(k * k * p for k, p in enumerate(probabilities)) - mean**2
    assert mean == pytest.approx(1, abs=1e-6) and variance == pytest.approx(1, abs=1e-6)
    assert POISSON_CUTS[7] == pytest.approx(math.fsum(1 / math.factorial(j) for j in range(8)) / math.e, abs=1e-12)


def test_nan_is_ranked_alike_with_one_and_many_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.1, 0.5, float("nan"), 2.0]) + (rng.random() if i % 2 else 0), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "p1 double, truth int").withColumn("pred", F.lit(1))
    counts = df.groupBy("p1").count().withColumnRenamed("count", "n")
    one = ranking.running_totals(counts, "p1", ["n"]).collect()
    many = ranking.running_totals(counts, "p1", ["n"], rows_per_bucket=5).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(math.isnan(r.p1) for r in one)
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),)] * 5, "x double")
    assert ranking.with_buckets(ends, "x", 2).count() == 10


def test_measured_size_of_any_type(spark):
    df = spark.range(10).select(
        F.create_map(F.lit("k"), F.lit("x" * 10_000)).alias("m"), F.struct(F.lit("y" * 10_000).alias("s")).alias("t"),
        F.lit("z" * 10_000).cast("binary").alias("b"), F.array(F.array(F.lit("w" * 10_000))).alias("a"), F.lit(None).cast("array<string>").alias("none"),
    )
    assert 400_000 < joins.measured_bytes(df) < 450_000
    vectors = spark.range(1).select(array_to_vector(F.array(F.lit(1.0))).alias("v"))
    assert joins.measured_bytes(vectors) > joins.BROADCAST_BYTES


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for name, size in (("a", 30), ("b", 3000), ("c", 300)):
        spark.range(size).select(F.lit(name).alias("f"), "id").coalesce(1).write.parquet(str(tmp_path / name))
    df = spark.read.parquet(*[str(tmp_path / n) for n in "abc"])
    rows = sorted(recode.with_row_id(df).collect(), key=lambda r: r["row"])
    assert [(r["f"], r["id"]) for r in rows] == [(n, i) for n, size in (("a", 30), ("b", 3000), ("c", 300)) for i in range(size)]
    assert [r["row"] for r in rows] == list(range(1, 3331))


def test_importance_of_a_calibrated_margin(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() + (i % 2), rng.random()], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>, truth int").withColumn("features", array_to_vector("v"))
    got = {r.variable: r.importance for r in models.importance(models.fit_model("svm", {"cost": 1.0}, df), ["signal", "noise"]).collect()}
    assert got["signal"] > got["noise"]
    with pytest.raises(ValueError):
        models.importance(models.fit_model("svm", {"cost": 1.0}, df), ["signal"])


def test_weighted_recipe_equals_repeated_rows(spark):
    rows = [(1, "red blue red green", 2), (2, "blue blue", 1), (3, "green yellow", 3)]
    df = spark.createDataFrame(rows, "id int, text string, weight int")
    again = df.withColumn("_i", F.explode(F.sequence(F.lit(1), "weight"))).drop("_i")
    recipe = features.TfidfRecipe(min_times=2, max_tokens=10, stop=())
    weighted, repeated = recipe.fit(df, weight="weight"), recipe.fit(again)
    assert sorted(recipe.vocabulary(df, "weight").collect()) == sorted(recipe.vocabulary(again).collect())
    assert weighted.terms == repeated.terms
    pair = [[r.features.toArray().tolist() for r in m.transform(df).orderBy("id").collect()] for m in (weighted, repeated)]
    assert pair[0] == pair[1]


def test_one_split_for_each_outcome(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(60)], "id int, a int, b int")
    parts, names = tune.outcome_parts(df, "id", ["a", "b"])
    for outcome, name in names.items():
        counts = {(r[outcome], r[name]): r["count"] for r in parts.groupBy(outcome, name).count().collect()}
        for value in (0, 1):
            total = counts[value, "train"] + counts[value, "test"]
            assert counts[value, "train"] == int(total * 0.8 + 1e-9)


def test_frequencies_in_one_scan(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    assert [(r.k, r.n, r.percentage) for r in describe.freq_table(df, "k").collect()] == [("x", 2, 50.0), (None, 1, 25.0), ("y", 1, 25.0)]
    assert metrics.METRICS


@pytest.mark.parametrize("kernel", ["uniform", "inverse", "triangular", "gaussian"])
def test_votes_in_place_equal_the_block_join(spark, monkeypatch, kernel):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(4)), float(rng.randrange(4))], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, truth int").withColumn("features", array_to_vector("v"))
    model = models.fit_model("knn", {"neighbors": 4, "weight_func": kernel}, df.filter("id < 40"))
    near = {r.id: r.p1 for r in model.transform(df).collect()}
    monkeypatch.setattr(models, "BROADCAST_BYTES", -1)
    joined = {r.id: r.p1 for r in model.transform(df).collect()}
    assert near == pytest.approx(joined)
    monkeypatch.undo()
    other = df.withColumnRenamed("id", "doc_id").filter("doc_id >= 40")
    assert {r.doc_id: r.p1 for r in model.transform(other).collect()} == pytest.approx({i: p for i, p in near.items() if i >= 40})
