"""Bootstrap refits in one pass: Gaussian naive Bayes for all replicates and outcomes at once.

A replicate is a column of weights, so its weighted counts, sums and sums of squares are one matrix product of the
weights with the features. One scan fits every replicate, a second one scores for each the rows it left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.functions.hashing import poisson_weight, unit
from textlabel.operators.metrics import METRICS, class_metrics, metrics_long

# Rows whose weights and scores are held at once: 512 rows by 1,000 replicates are 4 MB.
ROWS_AT_ONCE = 512
# Task results that one group adds up; with more tasks there is a round before.
TASKS_AT_ONCE = 64


def weight_array(id_col: str, replicates: int, seed: object = None) -> Column:
    """Weights of replicates 0 (the data as it is, 1) to `replicates` of a row, as `resample.weight_of` draws them.
    Each hash is made once."""
    def draw(r: Column) -> Column:
        key = r if seed is None else F.concat_ws(":", F.lit(str(seed)), r.cast("string"))
        return unit(key, F.col(id_col))

    draws = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long")), draw)
    drawn = F.transform(draws, lambda u: poisson_weight(u).cast("short"))
    one = F.array(F.lit(1).cast("short"))
    return F.concat(one, drawn) if replicates > 0 else one


def _narrow(df: DataFrame, id_col: str, outcomes: Sequence[str], features: str, replicates: int, seed: object) -> DataFrame:
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    x = vector_to_array(features) if vector else F.col(features).cast("array<double>")
    truths = F.array(*[F.coalesce(F.col(f"`{o}`").cast("double"), F.lit(-1.0)) for o in outcomes])  # -1: unknown
    return df.select(weight_array(id_col, replicates, seed).alias("w"), truths.alias("y"), x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield tuple(part.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1) for i in range(3))


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "data": [sum(np.frombuffer(d) for d in pdf["data"]).tobytes()]})


@dataclass
class ReplicateBayes:
    """Weighted moments (outcome, class, replicate, 1 + 2 p): weight, sums and sums of squares of the features. Replicate 0
    is the data as it is."""

    outcomes: list[str]
    sums: np.ndarray
    smooth: float = 1e-9

    @property
    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights, means, variances); a class without rows in a replicate has means and variances of 0."""
        width = (self.sums.shape[3] - 1) // 2
        n = self.sums[..., :1]
        mean = self.sums[..., 1 : 1 + width] / np.maximum(n, 1)
        return n[..., 0], mean, np.maximum(self.sums[..., 1 + width :] / np.maximum(n, 1) - mean**2, 0)

    def table(self, df: DataFrame, replicate: int = 0) -> DataFrame:
        """(outcome, truth, dim, n, mean, variance) of one replicate."""
        n, mean, var = self.moments
        rows = [
            (o, c, d, float(n[i, c, replicate]), float(mean[i, c, replicate, d]), float(var[i, c, replicate, d]))
            for i, o in enumerate(self.outcomes) for c in (0, 1) for d in range(mean.shape[3])
        ]
        return df.sparkSession.createDataFrame(rows, "outcome string, truth int, dim long, n double, mean double, variance double")

    def margins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of class 1 as const + a x + b x^2: arrays (outcome, replicate), twice (outcome, replicate, p). A
        class without rows loses; without any rows the odds are not a number and class 0 is predicted."""
        n, mean, var = self.moments
        var = var + self.smooth
        with np.errstate(divide="ignore", invalid="ignore"):
            const = np.log(n) - 0.5 * (np.log(var) + mean**2 / var).sum(3)
            a, b = mean / var, -0.5 / var
            return const[:, 1] - const[:, 0], a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]


def fit_replicates(df: DataFrame, id_col: str, outcomes: Sequence[str], features: str = "features", replicates: int = 1000, seed: object = None) -> ReplicateBayes:
    """Gaussian naive Bayes of every outcome (0/1, NULL where unknown) on every replicate, from one scan.

    A task adds up one matrix for each outcome and class, replicates by 1 + 2 p numbers; these are summed on the
    executors, and the sums (about 2 MB an outcome for 1,000 replicates and 64 features) reach the driver.
    """
    outcomes = list(outcomes)
    narrow = _narrow(df, id_col, outcomes, features, replicates, seed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for w, y, x in _blocks(batches):
            full = np.hstack([np.ones((len(x), 1)), x, x * x])
            for i in range(len(outcomes)):
                for c in (0, 1):
                    at = y[:, i] == c
                    sums[2 * i + c] = sums.get(2 * i + c, 0) + w[at].T @ full[at]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["cell", "data"])

    found = narrow.mapInArrow(each, "cell long, data binary").withColumn("part", F.floor(F.spark_partition_id() / TASKS_AT_ONCE))
    once = found.groupBy("cell", "part").applyInPandas(_add, "cell long, data binary")
    rows = once.groupBy("cell").applyInPandas(_add, "cell long, data binary").collect()
    if not rows:
        raise ValueError("no rows to fit on")
    by_cell = {r["cell"]: np.frombuffer(r["data"]) for r in rows}
    sums = np.stack([by_cell[k] for k in range(2 * len(outcomes))]).reshape(len(outcomes), 2, replicates + 1, -1)
    return ReplicateBayes(outcomes, sums)


def refit_confusion(df: DataFrame, id_col: str, outcomes: Sequence[str], features: str = "features", replicates: int = 1000, seed: object = None) -> DataFrame:
    """(outcome, replicate, tp, fp, fn, tn): naive Bayes refitted on each replicate and scored on the rows it left out;
    replicate 0, the apparent one, is fitted and scored on all rows. Rows without a truth count nowhere. Two scans."""
    model = fit_replicates(df, id_col, outcomes, features, replicates, seed)
    const, a, b = model.margins()
    names = model.outcomes

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), replicates + 1, 4), np.int64)
        for w, y, x in _blocks(batches):
            held = w == 0
            held[:, 0] = True
            for i in range(len(names)):
                yes = const[i] + x @ a[i].T + (x * x) @ b[i].T > 0
                one, zero = (y[:, i] == 1)[:, None] & held, (y[:, i] == 0)[:, None] & held
                counts[i] += np.stack([(one & yes).sum(0), (zero & yes).sum(0), (one & ~yes).sum(0), (zero & ~yes).sum(0)], 1)
        place = np.indices(counts.shape[:2]).reshape(2, -1)
        data = [pa.array(np.array(names, object)[place[0]], pa.string()), pa.array(place[1]), *[pa.array(counts[..., k].reshape(-1)) for k in range(4)]]
        yield pa.RecordBatch.from_arrays(data, names=["outcome", "replicate", "tp", "fp", "fn", "tn"])

    cells = ["tp", "fp", "fn", "tn"]
    schema = "outcome string, replicate long, " + ", ".join(f"{c} long" for c in cells)
    counted = _narrow(df, id_col, names, features, replicates, seed).mapInArrow(each, schema)
    return counted.groupBy("outcome", "replicate").agg(*[F.sum(c).alias(c) for c in cells])


def refit_metrics(conf: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Long metrics (outcome, replicate, metric, estimate) of `refit_confusion`, as `tune.bootstrap_refit_ci` takes them."""
    return metrics_long(class_metrics(conf, names), ["outcome", "replicate"], names)
