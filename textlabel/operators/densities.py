"""Naive Bayes with kernel densities: per class and feature a Gaussian density on a grid, from counted distinct values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.operators.ranking import running_totals
from textlabel.session import settle

POINTS = 512
# Density that stands for none at all, so that one unseen value does not rule a class out.
FLOOR = 0.001


def _values(df: DataFrame, features: str) -> Column:
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    return vector_to_array(features) if vector else F.col(features).cast("array<double>")


def bandwidths(counts: DataFrame, adjust: float = 1.0) -> DataFrame:
    """(truth, dim, n, mean, bw, low, step) from (truth, dim, v, n): the rule of thumb 0.9 min(sd, IQR / 1.34) n^-0.2, with
    sd where the quartiles coincide and the value itself, or 1, where all values do. The grid reaches three bandwidths
    beyond the values. Quartiles are exact, from running totals over buckets: no task sees all values of a feature."""
    group = F.concat_ws("/", "truth", "dim")
    runs = running_totals(counts.select(group.alias("variable"), "v", "n"), "v", ["n"], ["variable"], cached=True)
    v, n = F.col("v"), F.col("n")
    mean = F.sum(n * v) / F.sum(n)
    stats = counts.groupBy("truth", "dim").agg(F.sum("n").alias("n"), mean.alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    spread = counts.join(F.broadcast(stats.select("truth", "dim", "mean")), ["truth", "dim"])  # one row a class and feature
    square = spread.groupBy("truth", "dim").agg(F.sum(n * (v - F.col("mean")) ** 2).alias("square"))
    stats = stats.join(square, ["truth", "dim"]).withColumn("variable", group)

    def quantile(p: float) -> tuple[Column, Column, Column]:
        rank = F.max(F.lit(p) * (F.col("total") - 1))
        return rank, *[F.min(F.when(F.col("cum_n") > f(F.lit(p) * (F.col("total") - 1)), v)) for f in (F.floor, F.ceil)]

    ranked = runs.join(F.broadcast(stats.select("variable", F.col("n").alias("total"))), "variable")
    parts = {p: quantile(p) for p in (0.25, 0.75)}
    at = {p: low + (high - low) * (rank - F.floor(rank)) for p, (rank, low, high) in parts.items()}
    iqr = ranked.groupBy("variable").agg((at[0.75] - at[0.25]).alias("iqr"))
    sd = F.sqrt(F.col("square") / F.greatest(F.col("n") - 1, F.lit(1)))
    least = F.least(sd, F.col("iqr") / 1.34)
    lo = F.when(least > 0, least).when(sd > 0, sd).when(F.col("mean") != 0, F.abs("mean")).otherwise(1.0)
    out = stats.join(iqr, "variable").withColumn("bw", F.lit(0.9 * adjust) * lo * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    low = F.col("min") - 3 * F.col("bw")
    step = (F.col("max") + 3 * F.col("bw") - low) / (POINTS - 1)
    return out.select("truth", "dim", "n", "mean", "bw", low.alias("low"), step.alias("step"))


def fit_densities(df: DataFrame, truth: str = "truth", features: str = "features", adjust: float = 1.0) -> DataFrame:
    """(truth, dim, n, bw, low, step, density): one row for each class (0/1; NULL truths are left out) and feature, with the
    density at the grid points low + i step.

    Equal values are counted first, so the mass at zero of sparse features is one row. Each counted value is shared
    between its two grid points in proportion; a group then holds at most 512 bins. Missing values are left out.
    """
    cells = df.filter(F.col(truth).isNotNull()).select(F.col(truth).cast("int").alias("truth"), F.posexplode(_values(df, features)).alias("dim", "v"))
    cells = cells.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = settle(cells.groupBy("truth", "dim", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    stats = settle(bandwidths(counts, adjust), "bandwidths")
    place = (F.col("v") - F.col("low")) / F.col("step")
    at = F.least(F.floor(place), F.lit(POINTS - 2))
    right = place - at
    small = stats.select("truth", "dim", "low", "step")
    shared = counts.join(F.broadcast(small), ["truth", "dim"]).select(
        "truth", "dim", F.explode(F.array(F.struct(at.alias("i"), (F.col("n") * (1 - right)).alias("w")), F.struct((at + 1).alias("i"), (F.col("n") * right).alias("w")))).alias("b")
    )
    bins = shared.groupBy("truth", "dim", "b.i").agg(F.sum("b.w").alias("w")).join(F.broadcast(stats), ["truth", "dim"])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        far = (np.arange(POINTS)[:, None] - pdf["i"].to_numpy()[None, :]) * one["step"] / one["bw"]
        density = np.exp(-0.5 * far**2) @ pdf["w"].to_numpy() / (one["n"] * one["bw"] * np.sqrt(2 * np.pi))
        return pd.DataFrame({**{c: [one[c]] for c in ("truth", "dim", "n", "bw", "low", "step")}, "density": [density]})

    schema = "truth int, dim int, n long, bw double, low double, step double, density array<double>"
    return bins.groupBy("truth", "dim").applyInPandas(smooth, schema)


@dataclass
class KernelBayes:
    """Log priors (class), grids (class, feature, 2: low and step) and densities (class, feature, point)."""

    prior: np.ndarray
    grid: np.ndarray
    density: np.ndarray

    @staticmethod
    def fit(df: DataFrame, truth: str = "truth", features: str = "features", adjust: float = 1.0) -> KernelBayes:
        """About 8 kB a feature reach the driver. Both classes must occur."""
        rows = sorted(settle(fit_densities(df, truth, features, adjust), "densities").collect(), key=lambda r: (r["truth"], r["dim"]))
        if {r["truth"] for r in rows} != {0, 1}:
            raise ValueError("rows of both classes are needed")
        shape = 2, len(rows) // 2
        n = dict(df.filter(F.col(truth).isNotNull()).groupBy(F.col(truth).cast("int")).count().collect())
        grid = np.array([(r["low"], r["step"]) for r in rows]).reshape(*shape, 2)
        return KernelBayes(np.log([n[c] / (n[0] + n[1]) for c in (0, 1)]), grid, np.array([r["density"] for r in rows]).reshape(*shape, POINTS))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 of rows of features; a missing value says nothing."""
        out = np.full(len(x), self.prior[1] - self.prior[0])
        for d in range(x.shape[1]):
            for c, sign in ((0, -1), (1, 1)):
                low, step = self.grid[c, d]
                y = np.interp(x[:, d], low + step * np.arange(POINTS), self.density[c, d])
                out += sign * np.where(np.isnan(x[:, d]), 0, np.log(np.where(y > 0, y, FLOOR)))
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add `p0`, `p1` and `pred`. Row by row."""
        model = self

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            odds = model.log_odds(np.array(x.tolist(), float).reshape(len(x), -1)) if len(x) else np.zeros(0)
            return pd.Series(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

        out = df.withColumn("p1", share(_values(df, features)))
        return out.withColumn("p0", 1 - F.col("p1")).withColumn("pred", (F.col("p1") > 0.5).cast("int"))
