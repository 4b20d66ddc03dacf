"""Cross-validated tuning, ranking, final fit and bootstrap refits for many outcomes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.functions.numeric import round_numeric
from textlabel.operators.features import transform_folds
from textlabel.operators.metrics import (
    METRICS,
    bootstrap_ci,
    class_metrics,
    confusion,
    metrics_long,
    roc_auc,
)
from textlabel.operators.resample import stratified_folds, stratified_split, weight_of
from textlabel.plans.models import COMPARED, MODELS, Labeller, fit_model, penalty_grid, random_grid, score
from textlabel.session import new_table_path, settle

ALL_METRICS = [*METRICS, "roc_auc"]
PREDICTIONS = "outcome string, model string, config string, fold long, {id}, truth int, pred int, p0 double, p1 double"


@dataclass(frozen=True)
class Workflow:
    """One model on one feature recipe, with the parameter sets to try."""

    id: str
    recipe: object
    model: str
    grid: Sequence[Mapping[str, object]]

    def config(self, i: int) -> str:
        return f"Model{i + 1:02d}"


def workflows(
    recipe: object, models: Sequence[str] = COMPARED, size: int = 10, seed: int = 100, penalties: int = 30
) -> list[Workflow]:
    """One recipe with each model; the lasso gets its regular penalty grid."""
    out = []
    for name in models:
        spec = MODELS[name]
        grid = penalty_grid(levels=penalties) if name == "lasso" else random_grid(spec.space, size, seed)
        out.append(Workflow(spec.workflow_id, recipe, name, grid))
    return out


def _run(jobs: Sequence[Callable[[], object]], parallelism: int) -> list[object]:
    """Submit independent Spark jobs from a few threads, as `CrossValidator(parallelism=…)` does."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        inherit = inheritable_thread_target(SparkSession.active())
        return [f.result() for f in [pool.submit(inherit(j)) for j in jobs]]


def _read_folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tables that the jobs wrote, each into a folder of its own (writers sharing one would clash)."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _narrow(df: DataFrame, id_col: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), "features", F.col("truth").cast("int").alias("truth"), *more)


def tune(
    df: DataFrame,
    id_col: str,
    outcomes: Sequence[str],
    flows: Sequence[Workflow],
    v: int = 10,
    seed: int = 100,
    parallelism: int = 4,
    path: str | None = None,
    part: Mapping[str, str] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of every outcome x workflow x parameter set x fold.

    The recipe is fitted per fold on the analysis rows only, but one pass over the texts counts the tokens
    of all folds and another makes all folds' features, one column each, in the shared folder; all models
    and parameter sets read those. Each fit writes its assessment predictions there too, so finished work
    survives lost executors and no plan grows with the number of fits. Returns the predictions table.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark, "predictions")
    recipes = {id(f.recipe): f.recipe for f in flows}
    inputs = sorted({c for r in recipes.values() for c in r.inputs})

    def job(outcome: str, flow: Workflow, i: int, fold: int, table: DataFrame, column: str) -> Callable[[], object]:
        def run() -> None:
            rows = table.select("id", "truth", "fold", F.col(column).alias("features"))
            model = fit_model(flow.model, flow.grid[i], rows.filter(F.col("fold") != fold).drop("fold"), seed=seed)
            out = score(model, rows.filter(F.col("fold") == fold)).select(
                F.lit(outcome).alias("outcome"),
                F.lit(flow.id).alias("model"),
                F.lit(flow.config(i)).alias("config"),
                "fold",
                "id",
                "truth",
                "pred",
                "p0",
                "p1",
            )
            out.write.parquet(f"{path}/{uuid.uuid4().hex}")

        return run

    for outcome in outcomes:
        truth = F.col(f"`{outcome}`").cast("int").alias("truth")
        known = df.filter(F.col(f"`{outcome}`").isNotNull())
        if part:  # a split of its own for each outcome: only its train rows are tuned on
            known = known.filter(F.col(part[outcome]) == "train")
        known = known.select(F.col(id_col).alias("id"), truth, *inputs)
        folds = settle(stratified_folds(known, "id", "truth", v, seed), "folds")
        jobs = []
        for key, recipe in recipes.items():
            wide, names = transform_folds(recipe.fit_folds(folds, "fold", v), folds)
            table = settle(wide.select("id", "truth", "fold", *names), "features", even=True)
            jobs += [
                job(outcome, flow, i, fold, table, names[min(fold, len(names) - 1)])
                for flow in flows
                if id(flow.recipe) == key
                for i in range(len(flow.grid))
                for fold in range(v)
            ]
        _run(jobs, parallelism)
    id_type = df.schema[id_col].dataType.simpleString()
    return _read_folders(spark, path, PREDICTIONS.format(id=f"id {id_type}"))


def evaluate(
    pred: DataFrame, ids: Sequence[str] = ("outcome", "model", "config", "fold"), names: Sequence[str] = ALL_METRICS
) -> DataFrame:
    """Long metrics (ids, metric, estimate) of predictions, all groups in one job."""
    plain = [m for m in names if m != "roc_auc"]
    wide = class_metrics(confusion(pred, by=ids), plain)
    long = metrics_long(wide, ids, plain)
    if "roc_auc" in names:
        auc = roc_auc(pred, by=ids).select(*ids, F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("estimate"))
        long = long.unionByName(auc)
    return long


def rank_models(m: DataFrame, metric: str = "f_meas", best_only: bool = True) -> DataFrame:
    """Rows of `collect_metrics` with the rank of their (model, config) by the mean of one metric within
    the outcome, best first, ties by model and config. `best_only` keeps each model's best config.

    Works on the small table of averages: outcomes x models x configs rows. It is used twice, so it is
    persisted; behind it may lie a pass over all predictions.
    """
    m = m.persist()
    on = m.filter(F.col("metric") == metric).select("outcome", "model", "config", F.col("mean").alias("_by"))
    if best_only:
        first = W.partitionBy("outcome", "model").orderBy(F.desc_nulls_last("_by"), "config")
        on = on.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1).drop("_r")
    order = W.partitionBy("outcome").orderBy(F.desc_nulls_last("_by"), "model", "config")
    on = on.withColumn("rank", F.row_number().over(order).cast("long")).drop("_by")
    return m.join(on, ["outcome", "model", "config"])


def select_best(m: DataFrame, metric: str = "f_meas") -> DataFrame:
    """(outcome, model, config, mean): the best config of each model."""
    rows = m.filter((F.col("metric") == metric) & F.col("mean").isNotNull())
    best = F.min_by(F.struct("config", "mean"), F.struct(-F.col("mean"), "config")).alias("b")
    return rows.groupBy("outcome", "model").agg(best).select("outcome", "model", "b.config", "b.mean")


def metric_summary(m: DataFrame, best_only: bool = False, metric: str = "f_meas") -> DataFrame:
    """Mean with one standard error either way per metric and (model, config), and its rank within that
    metric: the data behind model comparison charts. `best_only` keeps each model's best config by `metric`."""
    if best_only:
        m = m.persist()
        best = select_best(m, metric).select("outcome", "model", "config")
        m = m.join(best, ["outcome", "model", "config"], "left_semi")
    order = W.partitionBy("outcome", "metric").orderBy(F.desc_nulls_last("mean"), "model", "config")
    err = F.coalesce("std_err", F.lit(0.0))
    return m.withColumns(
        {
            "lower": F.col("mean") - err,
            "upper": F.col("mean") + err,
            "rank": F.row_number().over(order).cast("long"),
        }
    )


def ranking_table(m: DataFrame, top: int | None = None, metric: str = "f_meas", half_even: bool = True) -> DataFrame:
    """Report table of ranked models (best config each): substance, model, mean_f_score, se, rank."""
    ranked = rank_models(m, metric).filter(F.col("metric") == metric)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    out = ranked.select(
        F.col("outcome").alias("substance"), "model", F.col("mean").alias("mean_f_score"), F.col("std_err").alias("se"), "rank"
    )
    return round_numeric(out, 3, half_even)


def best_workflows(m: DataFrame, flows: Sequence[Workflow], metric: str = "f_meas") -> dict[str, tuple[Workflow, dict]]:
    """{outcome: (workflow, parameters)} of the first-ranked model; one row per outcome reaches the driver."""
    by_id = {f.id: f for f in flows}
    rows = rank_models(m, metric).filter((F.col("rank") == 1) & (F.col("metric") == metric)).collect()
    out = {}
    for row in rows:
        flow = by_id[row["model"]]
        index = [flow.config(i) for i in range(len(flow.grid))].index(row["config"])
        out[row["outcome"]] = (flow, dict(flow.grid[index]))
    return out


def last_fit(
    df: DataFrame,
    id_col: str,
    best: Mapping[str, tuple[Workflow, Mapping]],
    part: str | Mapping[str, str] = "part",
    seed: int = 100,
    parallelism: int = 4,
) -> tuple[dict[str, Labeller], DataFrame]:
    """Fit each outcome's best workflow on the train rows and predict the test rows.

    `part` names the column that says train or test, one for all or one for each outcome (see `outcome_parts`).

    Returns the fitted models and one predictions table (outcome, model, id, truth, pred, p0, p1).
    """
    def job(outcome: str, flow: Workflow, params: Mapping) -> Callable[[], object]:
        def run() -> tuple[str, Labeller, DataFrame]:
            known = df.filter(F.col(f"`{outcome}`").isNotNull()).withColumn("truth", F.col(f"`{outcome}`"))
            mark = F.col(part if isinstance(part, str) else part[outcome])
            train, test = known.filter(mark == "train"), known.filter(mark == "test")
            recipe = flow.recipe.fit(train)
            features = settle(_narrow(recipe.transform(train), id_col), "features", even=True)
            model = fit_model(flow.model, params, features, seed=seed)
            pred = score(model, _narrow(recipe.transform(test), id_col)).select(
                F.lit(outcome).alias("outcome"), F.lit(flow.id).alias("model"), "id", "truth", "pred", "p0", "p1"
            )
            return outcome, Labeller(recipe, model), settle(pred, "test-predictions")

        return run

    done = _run([job(o, flow, params) for o, (flow, params) in best.items()], parallelism)
    table = done[0][2]
    for _, _, pred in done[1:]:
        table = table.unionByName(pred)
    return {o: fitted for o, fitted, _ in done}, table


def bootstrap_refit(
    test: DataFrame,
    id_col: str,
    best: Mapping[str, tuple[Workflow, Mapping]],
    replicates: int = 1000,
    seed: int = 100,
    parallelism: int = 4,
    apparent: bool = True,
) -> DataFrame:
    """Long metrics per outcome and replicate: the workflow is fitted on each resample of the test rows and
    scored on the rows that resample left out (replicate 0, "apparent", on all rows).

    A resample is a column of weights, not a copy of the rows. As the whole workflow is refitted, so is
    its recipe, on the rows the replicate drew.
    """
    spark = test.sparkSession
    path = new_table_path(spark, "bootstrap")
    id_type = test.schema[id_col].dataType.simpleString()
    for outcome, (flow, params) in best.items():
        known = test.filter(F.col(f"`{outcome}`").isNotNull()).withColumn("truth", F.col(f"`{outcome}`"))
        rows = settle(known, "bootstrap-rows")

        def job(rep: int) -> Callable[[], object]:
            def run() -> None:
                drawn = rows.withColumn("weight", F.lit(1).cast("long") if rep == 0 else weight_of(rep, id_col, seed))
                inside = drawn.filter("weight > 0")
                recipe = flow.recipe.fit(inside, weight="weight")
                features = _narrow(recipe.transform(inside), id_col, "weight").persist()
                model = fit_model(flow.model, params, features, weight="weight", seed=seed)
                held = drawn if rep == 0 else drawn.filter("weight = 0")
                pred = score(model, _narrow(recipe.transform(held), id_col))
                pred.select(
                    F.lit(outcome).alias("outcome"), F.lit(rep).cast("long").alias("replicate"), "id", "truth", "pred", "p0", "p1"
                ).write.parquet(f"{path}/{uuid.uuid4().hex}")
                features.unpersist()

            return run

        _run([job(r) for r in range(0 if apparent else 1, replicates + 1)], parallelism)
    schema = f"outcome string, replicate long, id {id_type}, truth int, pred int, p0 double, p1 double"
    return evaluate(_read_folders(spark, path, schema), ["outcome", "replicate"])


def bootstrap_refit_ci(m: DataFrame) -> DataFrame:
    """Percentile intervals of refitted replicates; the apparent replicate is no resample and is left out."""
    return bootstrap_ci(m.filter(F.col("replicate") > 0))


def split_by_outcome(
    df: DataFrame, id_col: str, outcomes: Sequence[str], prop: float = 0.8, seed: int = 100
) -> dict[str, DataFrame]:
    """One stratified split per outcome; the outcome's name joins the seed."""
    return {o: stratified_split(df, id_col, o, prop, f"{seed}:{o}") for o in outcomes}


def outcome_parts(
    df: DataFrame, id_col: str, outcomes: Sequence[str], prop: float = 0.8, seed: int = 100
) -> tuple[DataFrame, dict[str, str]]:
    """`df` with one train/test column for each outcome, stratified by it, and their names, as `tune` and `last_fit` take them."""
    names = {o: f"part_{i}" for i, o in enumerate(outcomes)}
    for outcome, name in names.items():
        df = stratified_split(df, id_col, outcome, prop, f"{seed}:{outcome}", out=name)
    return df, names


def grid_table(flows: Sequence[Workflow]) -> list[tuple[str, str, str]]:
    """(model, config, parameters as JSON) for storing beside the results."""
    return [(f.id, f.config(i), json.dumps(dict(p), sort_keys=True)) for f in flows for i, p in enumerate(f.grid)]
