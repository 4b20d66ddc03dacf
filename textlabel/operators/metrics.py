"""Confusion counts, threshold metrics, ROC and precision-recall curves, resample summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.functions.numeric import ratio
from textlabel.operators.ranking import ROWS_PER_BUCKET, running_totals
from textlabel.operators.resample import bootstrap_weights, replicate_ids, weight_of

CELLS = ["tp", "fp", "fn", "tn"]
METRICS = ["f_meas", "accuracy", "kap", "sens", "spec", "ppv", "npv", "recall", "precision"]


def _cells(truth: Column, est: Column, positive: object, weight: Column | None = None) -> dict[str, Column]:
    one = F.lit(1).cast("long") if weight is None else weight
    t, e = truth == F.lit(positive), est == F.lit(positive)
    tests = {"tp": t & e, "fp": ~t & e, "fn": t & ~e, "tn": ~t & ~e}
    return {k: F.sum(F.when(test, one).otherwise(F.lit(0).cast("long"))) for k, test in tests.items()}


def confusion(
    pred: DataFrame,
    truth: str = "truth",
    est: str = "pred",
    by: Sequence[str] = ("outcome",),
    positive: object = 1,
    weight: str | None = None,
) -> DataFrame:
    """tp, fp, fn, tn per group; rows where truth or estimate is NULL count nowhere."""
    w = None if weight is None else F.col(weight)
    cells = _cells(F.col(f"`{truth}`"), F.col(f"`{est}`"), positive, w)
    return pred.groupBy(*by).agg(*[c.alias(k) for k, c in cells.items()])


def confusion_wide(
    df: DataFrame,
    pairs: Mapping[str, tuple[str, str]],
    positive: object = 1,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Confusion counts of many outcomes, {outcome: (truth column, estimate column)}, from one aggregate
    over one scan: four sums per outcome leave a task, and rows are never repeated per outcome."""
    aggs = []
    for i, (truth, est) in enumerate(pairs.values()):
        cells = _cells(F.col(f"`{truth}`"), F.col(f"`{est}`"), positive, None if weight is None else F.col(weight))
        aggs += [F.coalesce(c, F.lit(0).cast("long")).alias(f"{k}{i}") for k, c in cells.items()]
    wide = df.groupBy(*by).agg(*aggs)
    rows = [
        F.struct(F.lit(name).alias("outcome"), *[F.col(f"{k}{i}").alias(k) for k in CELLS])
        for i, name in enumerate(pairs)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def class_metrics(conf: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Add one column per metric; NULL where a denominator is zero."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in CELLS)
    n = tp + fp + fn + tn
    observed = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sens, ppv = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp)
    formulas = {
        "f_meas": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "accuracy": observed,
        "kap": F.try_divide(observed - chance, 1 - chance),
        "sens": sens,
        "spec": F.try_divide(tn, tn + fp),
        "ppv": ppv,
        "npv": F.try_divide(tn, tn + fn),
        "recall": sens,
        "precision": ppv,
    }
    return conf.withColumns({m: formulas[m] for m in names})


def metrics_long(wide: DataFrame, ids: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    return wide.unpivot(list(ids), list(names), "metric", "estimate")


def score_counts(
    pred: DataFrame, score: str, truth: str, by: Sequence[str] = (), positive: object = 1
) -> DataFrame:
    """Positives and negatives per distinct score: a score shared by any number of rows is one row."""
    pos = F.sum(F.when(F.col(truth) == F.lit(positive), 1).otherwise(0))
    neg = F.sum(F.when(F.col(truth) != F.lit(positive), 1).otherwise(0))
    rows = pred.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
    return rows.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(pos.alias("pos"), neg.alias("neg"))


def _with_totals(
    pred: DataFrame, score: str, truth: str, by: Sequence[str], positive: object, rows_per_bucket: int
) -> tuple[DataFrame, DataFrame]:
    counts = score_counts(pred, score, truth, by, positive).persist()
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    runs = running_totals(counts, "threshold", ["pos", "neg"], by, rows_per_bucket, cached=True)
    return runs, totals


def _attach(runs: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group totals onto the curve rows: one row per group, so it is measured and broadcast."""
    from textlabel.operators.joins import lookup_join

    if by:
        return lookup_join(runs, totals, list(by), null_safe=True)
    return runs.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def roc_auc(
    pred: DataFrame,
    score: str = "p1",
    truth: str = "truth",
    by: Sequence[str] = ("outcome",),
    positive: object = 1,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact area under the ROC curve per group; tied scores count half."""
    counts = score_counts(pred, score, truth, by, positive)
    runs = running_totals(counts, "threshold", ["neg"], by, rows_per_bucket)
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return runs.groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def roc_curve(
    pred: DataFrame,
    score: str = "p1",
    truth: str = "truth",
    by: Sequence[str] = ("outcome",),
    positive: object = 1,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(by, threshold, specificity, sensitivity) for "positive when score >= threshold", with end rows at
    minus and plus infinity."""
    runs, totals = _with_totals(pred, score, truth, by, positive, rows_per_bucket)
    full = _attach(runs, totals, by)
    below_pos, below_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    curve = full.select(
        *by,
        "threshold",
        ratio(below_neg, F.col("all_neg")).alias("specificity"),
        ratio(F.col("all_pos") - below_pos, F.col("all_pos")).alias("sensitivity"),
    )
    ends = F.array(
        *[
            F.struct(
                F.lit(float(edge)).alias("threshold"),
                F.lit(spec).alias("specificity"),
                F.lit(sens).alias("sensitivity"),
            )
            for edge, spec, sens in (("-inf", 0.0, 1.0), ("inf", 1.0, 0.0))
        ]
    )
    return curve.unionByName(totals.select(*by, F.inline(ends)))


def pr_curve(
    pred: DataFrame,
    score: str = "p1",
    truth: str = "truth",
    by: Sequence[str] = ("outcome",),
    positive: object = 1,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(by, threshold, recall, precision), starting at an infinite threshold with recall 0, precision 1."""
    runs, totals = _with_totals(pred, score, truth, by, positive, rows_per_bucket)
    full = _attach(runs, totals, by)
    at_pos = F.col("all_pos") - (F.col("cum_pos") - F.col("pos"))
    at_neg = F.col("all_neg") - (F.col("cum_neg") - F.col("neg"))
    curve = full.select(
        *by,
        "threshold",
        ratio(at_pos, F.col("all_pos")).alias("recall"),
        ratio(at_pos, at_pos + at_neg).alias("precision"),
    )
    first = totals.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return curve.unionByName(first)


def collect_metrics(m: DataFrame, ids: Sequence[str] = ("outcome", "model", "config", "metric")) -> DataFrame:
    """Mean, number and standard error of a metric over its folds."""
    n = F.count("estimate")
    return m.groupBy(*ids).agg(
        F.avg("estimate").alias("mean"),
        n.alias("n"),
        F.try_divide(F.stddev_samp("estimate"), F.sqrt(n.cast("double"))).alias("std_err"),
    )


def bootstrap_ci(m: DataFrame, ids: Sequence[str] = ("outcome", "metric"), level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of a metric over replicates; NULL estimates are left out.

    A group holds one row per replicate (a thousand or so), so the exact percentile is cheap.
    """
    tail = (1 - level) / 2
    q = F.percentile("estimate", F.array(F.lit(tail), F.lit(1 - tail)))
    out = m.groupBy(*ids).agg(F.avg("estimate").alias("mean"), q.alias("q"))
    return out.select(*ids, "mean", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))


def bootstrap_confusion(
    pred: DataFrame,
    id_col: str = "id",
    truth: str = "truth",
    est: str = "pred",
    by: Sequence[str] = ("outcome",),
    replicates: int = 1000,
    seed: object = None,
    positive: object = 1,
) -> DataFrame:
    """Confusion counts per replicate. Weights are drawn and summed in the task that reads the row, so
    about replicates x groups small rows per task are shuffled."""
    cells = _cells(F.col(truth), F.col(est), positive, F.col("weight"))
    reps = pred.select(*by, id_col, truth, est).withColumn(
        "replicate", replicate_ids(1, replicates)
    )
    weighted = reps.withColumn("weight", weight_of(F.col("replicate"), id_col, seed)).filter("weight > 0")
    return weighted.groupBy(*by, "replicate").agg(*[c.alias(k) for k, c in cells.items()])


def bootstrap_confusion_wide(
    df: DataFrame,
    pairs: Mapping[str, tuple[str, str]],
    id_col: str = "id",
    replicates: int = 1000,
    seed: object = None,
    positive: object = 1,
) -> DataFrame:
    """(outcome, replicate, tp, fp, fn, tn) for many outcomes of the same records, {outcome: (truth,
    estimate)}: a record's weight in a replicate is drawn once and serves all outcomes."""
    used = sorted({c for pair in pairs.values() for c in pair})
    rows = df.select(id_col, *[F.col(f"`{c}`") for c in used])
    return confusion_wide(
        bootstrap_weights(rows, id_col, replicates, seed).filter("weight > 0"), pairs, positive, ["replicate"], "weight"
    )


def bootstrap_confusion_cells(
    conf: DataFrame, by: Sequence[str] = ("outcome",), replicates: int = 1000, seed: int = 100
) -> DataFrame:
    """The same distribution from the four confusion counts alone.

    A sum of n independent Poisson(1) weights is Poisson(n), so a table of any size needs four draws per
    replicate and group. Draws are seeded by (seed, group, replicate, cell): a retry repeats them.
    """
    @F.pandas_udf("long")
    def draw(n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(
            [int(np.random.default_rng(k & (2**63 - 1)).poisson(c)) for c, k in zip(n.to_numpy(), key.to_numpy())],
            dtype="int64",
        )

    reps = conf.select(*by, *CELLS).withColumn(
        "replicate", replicate_ids(1, replicates)
    )
    keys = [F.xxhash64(F.lit(seed), *[F.col(b) for b in by], F.col("replicate"), F.lit(c)) for c in CELLS]
    drawn = [draw(F.col(c), k).alias(c) for c, k in zip(CELLS, keys)]
    return reps.select(*by, "replicate", *drawn)


def bootstrap_metric_ci(
    pred: DataFrame,
    id_col: str = "id",
    truth: str = "truth",
    est: str = "pred",
    by: Sequence[str] = ("outcome",),
    replicates: int = 1000,
    seed: object = None,
    names: Sequence[str] = METRICS,
) -> DataFrame:
    """Interval of each metric from resampled predictions, without refitting the model."""
    conf = bootstrap_confusion(pred, id_col, truth, est, by, replicates, seed)
    long = metrics_long(class_metrics(conf, names), [*by, "replicate"], names)
    return bootstrap_ci(long, [*by, "metric"])
