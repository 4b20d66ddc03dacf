"""Classifier registry: name -> tuning space and `pyspark.ml` pipeline, plus fitted-model helpers.

All models learn the event "label = 1". The network of `pyspark.ml` has neither a weight penalty nor row weights, so
it comes from `network.py`; its boosted trees are of first order, so they come from `boosting.py`. The linear SVM has
no probabilities, so its margin is calibrated by a one-feature logistic regression (Platt scaling) fitted on the same rows.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabel.operators.features import EmbeddingModel, TfidfModel, VectorRecipe
from textlabel.operators.joins import BROADCAST_BYTES, measured_bytes
from textlabel.operators.neighbours import KERNELS, knn, knn_vote, vote_in_place
from textlabel.plans.boosting import Boosted, fit_boosted
from textlabel.plans.network import Networks, fit_networks

Params = Mapping[str, object]
FEATURES, TRUTH, WEIGHT = "features", "truth", "weight"
SCRATCH = ["rawPrediction", "probability", "prediction", "margin", "margin_class", "margin_one"]


def log_uniform(low: float, high: float, base: float = 10.0) -> Callable[[float], float]:
    """Map a number in [0, 1) to base**low .. base**high."""
    return lambda u: base ** (low + u * (high - low))


def whole(low: int, high: int) -> Callable[[float], int]:
    return lambda u: low + min(int(u * (high - low + 1)), high - low)


def real(low: float, high: float) -> Callable[[float], float]:
    return lambda u: low + u * (high - low)


def one_of(values: Sequence[object]) -> Callable[[float], object]:
    return lambda u: values[min(int(u * len(values)), len(values) - 1)]


@dataclass(frozen=True)
class ModelSpec:
    name: str
    label: str
    build: Callable[..., object]
    space: Mapping[str, Callable[[float], object]] = field(default_factory=dict)
    weights: bool = True  # takes fractional row weights

    @property
    def workflow_id(self) -> str:
        return "recipe_" + self.label.replace(" ", ".")


def _common(weight: str | None) -> dict:
    base = {"featuresCol": FEATURES, "labelCol": TRUTH}
    return {**base, "weightCol": weight} if weight else base


def _logistic(p: Params, dim: int, weight: str | None, seed: int):
    return LogisticRegression(regParam=0.0, maxIter=int(p.get("max_iter", 50)), **_common(weight))


def _lasso(p: Params, dim: int, weight: str | None, seed: int):
    return LogisticRegression(
        elasticNetParam=1.0, regParam=float(p.get("penalty", 0.01)), maxIter=int(p.get("max_iter", 100)), tol=1e-5, **_common(weight)
    )


def _naive_bayes(p: Params, dim: int, weight: str | None, seed: int):
    return NaiveBayes(modelType="gaussian", **_common(weight))


def _subset(p: Params) -> str:
    return str(round(float(p["mtry"]), 4)) if "mtry" in p else "auto"


def _random_forest(p: Params, dim: int, weight: str | None, seed: int):
    return RandomForestClassifier(
        numTrees=int(p.get("trees", 50)),
        minInstancesPerNode=int(p.get("min_n", 2)),
        featureSubsetStrategy=_subset(p),
        maxDepth=int(p.get("depth", 8)),
        seed=seed,
        **_common(weight),
    )


@dataclass
class BoostedClassifier:
    params: dict
    weight: str | None
    seed: int

    def fit(self, df: DataFrame) -> Boosted:
        return fit_boosted(df, [TRUTH], [self.params], features=FEATURES, weight=self.weight, seed=self.seed)


def _gbt(p: Params, dim: int, weight: str | None, seed: int):
    return BoostedClassifier(dict(p), weight, seed)


def _svm(p: Params, dim: int, weight: str | None, seed: int):
    """Cost is per row, as margin-based solvers state it; LinearSVC wants the penalty 1 / (cost * rows)."""
    rows = float(p["rows"])
    svc = LinearSVC(
        regParam=1.0 / (float(p.get("cost", 1.0)) * max(rows, 1.0)),
        maxIter=int(p.get("max_iter", 50)),
        rawPredictionCol="margin",
        predictionCol="margin_class",
        **_common(weight),
    )
    one = VectorSlicer(inputCol="margin", outputCol="margin_one", indices=[1])
    platt = LogisticRegression(
        **{**_common(weight), "featuresCol": "margin_one"}, regParam=1e-6, maxIter=50
    )
    return [svc, one, platt]


@dataclass
class NetworkClassifier:
    params: dict
    weight: str | None
    seed: int

    def fit(self, df: DataFrame) -> Networks:
        return fit_networks(df, [TRUTH], [self.params], features=FEATURES, weight=self.weight, seed=self.seed)


def _mlp(p: Params, dim: int, weight: str | None, seed: int):
    return NetworkClassifier({"hidden_units": 5, "epochs": 50, **p}, weight, seed)


@dataclass
class KnnClassifier:
    k: int = 5
    kernel: str = "uniform"

    def fit(self, df: DataFrame) -> KnnModel:
        return KnnModel(df, self.k, self.kernel)


@dataclass
class KnnModel:
    """Keeps its training rows as a table.

    Up to `BROADCAST_BYTES` of them (measured) go to the tasks, and rows are scored where they lie; beyond that the
    block join of `knn` takes over, for which rows to score need the training rows' `id` column."""

    train: DataFrame
    k: int
    kernel: str

    def transform(self, df: DataFrame) -> DataFrame:
        def plain(frame: DataFrame, *cols: str) -> DataFrame:
            return frame.select("id", vector_to_array(FEATURES).alias("vec"), *cols)

        train = plain(self.train, TRUTH)
        if WEIGHT in self.train.columns:  # whole-number weights repeat the row, as a resample does
            train = plain(self.train, TRUTH, F.explode(F.sequence(F.lit(1), F.col(WEIGHT).cast("int"))).alias("_i"))
            train = train.select(F.concat_ws("#", F.col("id").cast("string"), "_i").alias("id"), "vec", TRUTH)
        if measured_bytes(train) <= BROADCAST_BYTES:
            share = vote_in_place([(r["id"], r["vec"], r[TRUTH]) for r in train.collect()], self.k, self.kernel)
            scored = df.withColumn("p1", share(vector_to_array(FEATURES)))
            return scored.withColumn("p0", 1 - F.col("p1")).withColumn("pred", (F.col("p1") > 0.5).cast("int"))
        near = knn(plain(df), train, self.k + 1, "id", "vec", TRUTH)
        votes = knn_vote(near, self.k, self.kernel).withColumnRenamed("query_id", "id")
        scored = df.join(votes, "id", "left")
        return scored.withColumn("p0", 1 - F.col("p1")).withColumn("pred", (F.col("p1") > 0.5).cast("int"))

    def save(self, path: str) -> None:
        keep = [c for c in ("id", FEATURES, TRUTH, WEIGHT) if c in self.train.columns]
        self.train.select(*keep).write.mode("overwrite").parquet(path + "/train")
        _write_json(path, {"kind": "knn", "k": self.k, "kernel": self.kernel})


def _knn(p: Params, dim: int, weight: str | None, seed: int):
    return KnnClassifier(int(p.get("neighbors", 5)), str(p.get("weight_func", "uniform")))


Fitted = PipelineModel | KnnModel | Networks | Boosted
OWN = {"knn": KnnModel, "network": Networks, "boosted": Boosted}
SUBSET = real(0.1, 1.0)
MODELS: dict[str, ModelSpec] = {
    m.name: m
    for m in [
        ModelSpec("logistic", "Logistic regression", _logistic),
        ModelSpec("naive_bayes", "Naive Bayes", _naive_bayes),
        ModelSpec(
            "random_forest", "Random forest", _random_forest, {"trees": whole(20, 200), "min_n": whole(2, 40), "mtry": SUBSET}
        ),
        ModelSpec(
            "gbt", "Gradient boosting", _gbt,
            {"trees": whole(10, 100), "depth": whole(2, 8), "learn_rate": log_uniform(-3, -0.5), "min_n": real(2, 40), "loss_reduction": log_uniform(-10, 1.5), "mtry": SUBSET},
        ),
        ModelSpec("knn", "KNN", _knn, {"neighbors": whole(1, 15), "weight_func": one_of(KERNELS)}, weights=False),
        ModelSpec("svm", "SVM", _svm, {"cost": log_uniform(-10, 5, 2.0)}),
        ModelSpec("mlp", "MLP", _mlp, {"hidden_units": whole(1, 10), "penalty": log_uniform(-10, 0), "epochs": whole(10, 1000)}),
        ModelSpec("lasso", "Lasso", _lasso, {"penalty": log_uniform(-5, 0)}),
    ]
}
# The seven that are compared with each other; the lasso has a comparison of its own.
COMPARED = ["logistic", "naive_bayes", "random_forest", "gbt", "knn", "svm", "mlp"]


def penalty_grid(low: float = -5, high: float = 0, levels: int = 30) -> list[dict]:
    """Penalties evenly spaced on the log10 scale."""
    step = (high - low) / (levels - 1) if levels > 1 else 0.0
    return [{"penalty": 10.0 ** (low + i * step)} for i in range(levels)]


def random_grid(space: Mapping[str, Callable[[float], object]], size: int = 10, seed: int = 100) -> list[dict]:
    """Latin hypercube: each parameter visits each of `size` equal slices of its range once."""
    if not space:
        return [{}]
    rng = random.Random(seed)
    columns = {}
    for name in sorted(space):
        slots = [(i + rng.random()) / size for i in range(size)]
        rng.shuffle(slots)
        columns[name] = [space[name](u) for u in slots]
    return [{name: columns[name][i] for name in columns} for i in range(size)]


def _drop_summary(stage: object) -> None:
    """Forget the training summary. It would travel with the model into every task, with its session;
    and a session that has an `Observation` cannot be serialised."""
    if getattr(stage, "hasSummary", False):
        none = SparkSession.active().sparkContext._jvm.scala.Option.empty()
        stage._java_obj.setSummary(none)


def fit_model(
    spec: ModelSpec | str, params: Params, train: DataFrame, weight: str | None = None, seed: int = 100
) -> Fitted:
    """Fit one model on `features` and `truth` (0/1) of the training rows.

    `weight` names a column of whole-number weights; models without weights get repeated rows.
    """
    spec = MODELS[spec] if isinstance(spec, str) else spec
    params = dict(params)
    if spec.name == "knn":
        if weight and weight != WEIGHT:
            train = train.withColumnRenamed(weight, WEIGHT)
        return spec.build(params, 0, None, seed).fit(train if weight else train.drop(WEIGHT))
    if weight and not spec.weights:
        train = train.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))).drop("_i")
        weight = None
    if spec.name == "svm":
        params["rows"] = train.count()
    if spec.name in ("mlp", "gbt"):
        return spec.build(params, 0, weight, seed).fit(train)
    data = train.withColumn(TRUTH, F.col(TRUTH).cast("double"))
    if weight:
        data = data.withColumn(weight, F.col(weight).cast("double"))
    steps = spec.build(params, 0, weight, seed)
    stages = []
    for step in steps if isinstance(steps, list) else [steps]:
        stage = step.fit(data) if isinstance(step, Estimator) else step
        _drop_summary(stage)
        stages.append(stage)
        data = stage.transform(data)
    return PipelineModel(stages)


def score(model: Fitted, df: DataFrame) -> DataFrame:
    """Add `pred` (0/1), `p0` and `p1`; drop what the model leaves behind."""
    if isinstance(model, tuple(OWN.values())):
        return model.transform(df)
    out = model.transform(df)
    p = vector_to_array("probability")
    out = out.withColumns({"p0": p[0], "p1": p[1], "pred": F.col("prediction").cast("int")})
    return out.drop(*SCRATCH)


def importance(model: PipelineModel | Boosted, terms: Sequence[str]) -> DataFrame:
    """(variable, importance, sign): size of a coefficient and the direction of its effect on the event,
    the impurity importance of a forest, or the share of the splits of boosted trees. The vocabulary is at most a few
    thousand terms."""
    if isinstance(model, Boosted):
        used = model.importance()
        if len(used) != len(terms):
            raise ValueError(f"{len(terms)} terms for {len(used)} features")
        shares = [(t, float(n) / max(int(used.sum()), 1), "Importance") for t, n in zip(terms, used)]
        return SparkSession.active().createDataFrame(shares, "variable string, importance double, sign string")
    # Of several stages (a margin and its calibration) the first one that works on the features counts.
    fitted = [s for s in model.stages if hasattr(s, "coefficients") or hasattr(s, "featureImportances")]
    if not fitted:
        raise ValueError("this model has no importances")
    first = fitted[0]
    spark = SparkSession.active()
    size = first.coefficients.size if hasattr(first, "coefficients") else first.featureImportances.size
    if size != len(terms):
        raise ValueError(f"{len(terms)} terms for {size} features")
    if hasattr(first, "coefficients"):
        values = [float(x) for x in first.coefficients.toArray()]
        rows = [
            (t, abs(v), "Positive" if v > 0 else "Negative" if v < 0 else "Zero") for t, v in zip(terms, values)
        ]
    else:
        rows = [(t, float(v), "Importance") for t, v in zip(terms, first.featureImportances.toArray())]
    return spark.createDataFrame(rows, "variable string, importance double, sign string")


@dataclass
class Labeller:
    """A fitted recipe and classifier for one outcome."""

    recipe: TfidfModel | EmbeddingModel | VectorRecipe
    model: Fitted

    def transform(self, df: DataFrame) -> DataFrame:
        return score(self.model, self.recipe.transform(df)).drop(FEATURES)


def _write_json(path: str, content: dict) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(
        path + "/meta"
    )


def _read_json(path: str) -> dict:
    return json.loads(SparkSession.active().read.text(path + "/meta").first()["value"])


def save_models(models: Mapping[str, Labeller], path: str) -> None:
    """One folder per outcome, found again by name and not by position."""
    for outcome, fitted in models.items():
        folder = f"{path}/{quote(outcome, safe='')}"
        kind = type(fitted.recipe).__name__
        if isinstance(fitted.recipe, VectorRecipe):
            _write_json(folder + "/recipe", {"col": fitted.recipe.col, "out": fitted.recipe.out})
        else:
            fitted.recipe.save(folder + "/recipe")
        stored = next((k for k, kind_of in OWN.items() if isinstance(fitted.model, kind_of)), "ml")
        if stored == "ml":
            fitted.model.write().overwrite().save(folder + "/model")
        else:
            fitted.model.save(folder + "/model")
        _write_json(folder, {"recipe": kind, "model": stored})
    _write_json(path, {"outcomes": list(models)})


def load_models(paths: str | Sequence[str]) -> dict[str, Labeller]:
    """Models of one or more folders, later folders adding to earlier ones."""
    spark = SparkSession.active()
    out = {}
    for path in [paths] if isinstance(paths, str) else paths:
        for outcome in _read_json(path)["outcomes"]:
            folder = f"{path}/{quote(outcome, safe='')}"
            kinds = _read_json(folder)
            if kinds["recipe"] == "TfidfModel":
                recipe = TfidfModel.load(folder + "/recipe")
            elif kinds["recipe"] == "EmbeddingModel":
                recipe = EmbeddingModel.load(folder + "/recipe")
            else:
                recipe = VectorRecipe(**_read_json(folder + "/recipe"))
            if kinds["model"] == "knn":
                meta = _read_json(folder + "/model")
                model = KnnModel(spark.read.parquet(folder + "/model/train"), meta["k"], meta["kernel"])
            elif kinds["model"] in OWN:
                model = OWN[kinds["model"]].load(folder + "/model")
            else:
                model = PipelineModel.load(folder + "/model")
            out[unquote(outcome)] = Labeller(recipe, model)
    return out
