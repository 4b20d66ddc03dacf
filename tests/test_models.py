import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlabel.operators import features, metrics, recode, resample
from textlabel.plans import models, report, score, tune
from textlabel.session import new_table_path

QUICK = {
    "random_forest": {"trees": 5, "min_n": 2, "mtry": 0.5},
    "gbt": {"trees": 5, "depth": 2, "mtry": 1.0},
    "knn": {"neighbors": 5, "weight_func": "gaussian"},
    "svm": {"cost": 1.0, "max_iter": 20},
    "mlp": {"hidden_units": 3, "epochs": 20},
    "lasso": {"penalty": 0.01},
}


@pytest.fixture(scope="module")
def points(spark):
    """Two overlapping clouds, label 1 to the right."""
    rng = np.random.default_rng(2)
    data = [(i, i % 2, [float(x) for x in rng.normal([1.5 * (i % 2), 0, 0], 1)]) for i in range(160)]
    df = spark.createDataFrame(data, "id long, truth int, emb array<double>")
    return df.withColumn("features", array_to_vector("emb")).persist()


@pytest.mark.parametrize("name", list(models.MODELS))
def test_each_model_learns_and_scores(points, name):
    model = models.fit_model(name, QUICK.get(name, {}), points)
    out = models.score(model, points.drop("truth"))
    assert set(out.columns) == {"id", "emb", "features", "pred", "p0", "p1"}
    joined = out.join(points.select("id", "truth"), "id")
    assert joined.count() == 160
    assert joined.filter((F.abs(F.col("p0") + F.col("p1") - 1) > 1e-9) | F.col("p1").isNull()).count() == 0
    auc = metrics.roc_auc(joined.withColumn("outcome", F.lit("o"))).first()["roc_auc"]
    assert auc > 0.7


@pytest.mark.parametrize("name", ["naive_bayes", "knn", "mlp"])
def test_weights_equal_repeated_rows(points, name):
    weighted = points.withColumn("weight", (F.col("id") % 3).cast("long")).filter("weight > 0")
    copies = weighted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("i", "weight")
    a = models.score(models.fit_model(name, QUICK.get(name, {}), weighted, weight="weight"), points)
    b = models.score(models.fit_model(name, QUICK.get(name, {}), copies), points)
    joined = a.select("id", F.col("p1").alias("a")).join(b.select("id", F.col("p1").alias("b")), "id")
    assert joined.filter(F.abs(F.col("a") - F.col("b")) > (0.05 if name == "mlp" else 1e-6)).count() == 0


def test_strong_penalty_empties_the_lasso(points):
    model = models.fit_model("lasso", {"penalty": 10.0}, points)
    imp = models.importance(model, ["x", "y", "z"])
    assert [r["importance"] for r in imp.collect()] == [0.0] * 3
    weak = {r["variable"]: r for r in models.importance(models.fit_model("lasso", {"penalty": 0.001}, points), ["x", "y", "z"]).collect()}
    assert weak["x"]["sign"] == "Positive" and weak["x"]["importance"] > weak["y"]["importance"]
    top = report.top_terms(models.importance(models.fit_model("lasso", {"penalty": 0.05}, points), ["x", "y", "z"]))
    assert top.count() >= 1 and top.filter("importance = 0").count() == 0


@pytest.mark.parametrize("name", ["random_forest", "gbt"])
def test_tree_importance(points, name):
    imp = models.importance(models.fit_model(name, QUICK[name], points), ["x", "y", "z"])
    rows = {r["variable"]: r["importance"] for r in imp.collect()}
    assert math.isclose(sum(rows.values()), 1, abs_tol=1e-6) and max(rows, key=rows.get) == "x"


def test_grids():
    lam = models.penalty_grid()
    assert len(lam) == 30 and math.isclose(lam[0]["penalty"], 1e-5) and math.isclose(lam[-1]["penalty"], 1)
    grid = models.random_grid(models.MODELS["random_forest"].space, 10, 1)
    assert len(grid) == 10 and grid == models.random_grid(models.MODELS["random_forest"].space, 10, 1)
    assert all(20 <= p["trees"] <= 200 and 2 <= p["min_n"] <= 40 and 0.1 <= p["mtry"] <= 1 for p in grid)
    slices = sorted(int((p["mtry"] - 0.1) / 0.9 * 10) for p in grid)
    assert slices == list(range(10))  # each tenth of the range once
    assert models.random_grid({}, 10) == [{}]


def test_model_works_after_an_observation(points):
    seen_df, seen = recode.audited(points, "rows")
    model = models.fit_model("logistic", {}, seen_df)
    assert models.score(model, points).count() == 160


@pytest.fixture(scope="module")
def notes(spark):
    rng = np.random.default_rng(4)
    words = ["fentanyl", "heroin", "fall", "car", "heart", "the", "found", "home"]
    rows = []
    for i in range(120):
        y = i % 2
        picked = list(rng.choice(words[2:], 6)) + ([words[0]] if y else []) + ([words[1]] if i % 3 == 0 else [])
        rows.append((f"n{i}", " ".join(picked), y, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "id string, text string, `Any Opioids` int, Heroin int")


def test_tuning_to_report(spark, notes, rows):
    recipe = features.TfidfRecipe(min_times=2)
    flows = tune.workflows(recipe, ["naive_bayes", "lasso"], penalties=2)
    assert [f.id for f in flows] == ["recipe_Naive.Bayes", "recipe_Lasso"] and len(flows[1].grid) == 2
    pred = tune.tune(notes, "id", ["Any Opioids", "Heroin"], flows, v=3).persist()
    sizes = {(r["outcome"], r["model"], r["config"]): r["count"] for r in pred.groupBy("outcome", "model", "config").count().collect()}
    assert set(sizes.values()) == {120} and len(sizes) == 6  # every row is held out once
    m = metrics.collect_metrics(tune.evaluate(pred)).persist()
    assert {r["metric"] for r in m.select("metric").distinct().collect()} == set(tune.ALL_METRICS)
    assert m.filter("n > 3").count() == 0
    ranked = tune.rank_models(m).filter("metric = 'f_meas'")
    assert rows(ranked, "outcome", "rank") == [("Any Opioids", 1), ("Any Opioids", 2), ("Heroin", 1), ("Heroin", 2)]
    assert tune.rank_models(m, best_only=False).filter("metric = 'f_meas'").count() == 6
    assert tune.ranking_table(m, top=1).columns == ["substance", "model", "mean_f_score", "se", "rank"]
    assert tune.metric_summary(m, best_only=True).filter("lower > upper").count() == 0

    split = resample.stratified_split(notes, "id", "Any Opioids", 0.75, 1)
    best = tune.best_workflows(m, flows)
    fitted, test_pred = tune.last_fit(split, "id", best)
    test_rows = split.filter("part = 'test'").count()
    assert test_pred.count() == 2 * test_rows
    table = report.test_table(tune.evaluate(test_pred, ["outcome"]))
    assert table.filter("f_score > 0.5").count() == 2 and "auroc" in table.columns

    path = new_table_path(spark, "models")
    models.save_models(fitted, path)
    back = models.load_models([path])
    assert list(back) == list(fitted)
    new = notes.select("id", "text").withColumn("cui", F.lit(None).cast("string"))
    small, complete = score.predict_small(new, back), score.predict_complete(new, back)
    assert small.columns == ["id", "text", "cui", *fitted]
    assert complete.columns[:5] == ["text", "cui", "Any Opioids", "Any Opioids_pred_1", "Any Opioids_pred_0"]
    assert rows(small, "text", "`Any Opioids`", "Heroin") == rows(complete, "text", "`Any Opioids`", "Heroin")
    assert rows(small) == rows(score.predict_small(new, fitted))


def test_refitted_bootstrap(notes):
    flow = tune.Workflow("recipe_Naive.Bayes", features.TfidfRecipe(min_times=2), "naive_bayes", [{}])
    m = tune.bootstrap_refit(notes, "id", {"Any Opioids": (flow, {})}, replicates=3).persist()
    assert {r["replicate"] for r in m.select("replicate").distinct().collect()} == {0, 1, 2, 3}
    ci = report.ci_table(tune.bootstrap_refit_ci(m)).first()
    assert ci["f_score_lower"] <= ci["f_score"] <= ci["f_score_upper"]


@pytest.mark.parametrize("name", ["knn", "mlp", "gbt"])
def test_models_of_our_own_survive_saving(spark, points, rows, name):
    model = models.fit_model(name, QUICK[name], points)
    path = new_table_path(spark, name)
    models.save_models({"x.y z": models.Labeller(features.VectorRecipe("emb"), model)}, path)
    back = models.load_models(path)["x.y z"]
    raw = points.select("id", "emb")
    assert rows(back.transform(raw), "id", "pred", "p1") == rows(models.score(model, points), "id", "pred", "p1")


def test_scoring_example_gets_concepts(spark):
    lexicon = spark.createDataFrame(
        [("fentanyl", "fentanyl", "C0015846", "Organic Chemical"), ("gabapentin", "gabapentin", "C0060926", "Organic Chemical"),
         ("overdose", "overdose", "C0029944", "Injury or Poisoning"), ("methadone", "methadone", "C0025605", "Organic Chemical")],
        "alias string, entity string, cui string, semantic_type string",
    )
    df = spark.createDataFrame([("patient overdose fentanyl gabapentin methadone", "1"), ("none", "2")], "text string, id string")
    got = {r["id"]: r for r in score.prepare(df, lexicon).collect()}
    assert got["1"]["cui"] == "C0015846 C0060926 C0025605"
    assert got["1"]["text"] == "patient, overdose, fentanyl, gabapentin, methadone"
    assert got["2"]["cui"] is None
