"""Networks with one hidden layer, a weight penalty and row weights: all runs (outcome x parameters x fold) in one solver.

A step takes loss and gradient of runs, as products of a few hundred rows with the weights of many of them, and moves each
run by a quasi-Newton step of its own. Where there are enough runs to keep all tasks busy and the rows, packed, are few enough
to be held by each, a task follows its share of the runs to their ends. Else each step reads the rows once: a task gives the
sums of all runs still open over its rows, and the driver moves the runs.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabel.session import settle

ROWS_AT_ONCE = 256
# Hidden values of so many runs x units at once: with the rows of a block they stay in a core's cache.
COLUMNS = 256
# So many runs at once: their log odds are small arrays, for which memory is at hand.
RUNS = 48
# Packed rows up to this are broadcast, and held by each task.
HELD_BYTES = 128 << 20
# Above this the sums of the tasks are added by groups on the executors before they reach the driver.
DIRECT_BYTES = 64 << 20
# Start weights lie between -0.7 and 0.7.
START = 0.7
MEMORY = 10
LESS, SURE = 1e-4, 1e-10


@dataclass(frozen=True)
class Run:
    outcome: int
    config: int
    units: int
    penalty: float
    epochs: int
    fold: int  # the fold that is left out; -1: none


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def feature_array(df: DataFrame, features: str) -> Column:
    """Features as an array without gaps: missing and NaN values are 0."""
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    values = vector_to_array(features) if vector else F.col(features).cast("array<double>")
    return F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))


def _lists(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def blocks(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(folds, truths with NaN where unknown, weights, features with a leading 1) of a few hundred rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            n = part.num_rows
            x = np.hstack([np.ones((n, 1)), _lists(part.column(3), n)])
            yield part.column(0).to_numpy(zero_copy_only=False), _lists(part.column(1), n), part.column(2).to_numpy(zero_copy_only=False), x


def forward(theta: np.ndarray, x: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values (row, run, unit) and log odds (row, run) of weights (run, width * units + units + 1)."""
    runs, width = len(theta), x.shape[1]
    first = theta[:, : width * units].reshape(runs, width, units).transpose(1, 0, 2).reshape(width, -1)
    hidden = _logistic(x @ first).reshape(len(x), runs, units)
    return hidden, np.einsum("nru,ru->nr", hidden, theta[:, width * units : -1]) + theta[:, -1]


class Sums:
    """Weighted log losses (run) and gradients (run, weights) of weights (run, width * units + units + 1), summed up over blocks of
    rows. Memory for two arrays of hidden values is kept: new memory for each block would cost as much as the work."""

    def __init__(self, theta: np.ndarray, width: int, units: int, room: np.ndarray | None = None):
        runs = len(theta)
        # Hidden values lie by unit, run, then row, so that every step below goes along the rows.
        self.first = -theta[:, : width * units].reshape(runs, width, units).transpose(2, 0, 1).reshape(-1, width)
        self.second = np.ascontiguousarray(theta[:, width * units : -1].T)
        self.last = theta[:, -1:]
        self.room = np.empty(2 * ROWS_AT_ONCE * units * runs) if room is None else room
        self.loss, self.grad = np.zeros(runs), np.zeros((units * runs, width))
        self.slope, self.off = np.zeros((units, runs)), np.zeros(runs)

    def add(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Rows, at most `ROWS_AT_ONCE`, with truths and weights (run, row)."""
        n, (units, runs) = len(x), self.second.shape
        hidden, back = self.room[: 2 * units * runs * n].reshape(2, units * runs, n)
        np.matmul(self.first, x.T, out=hidden)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
            np.exp(hidden, out=hidden)
        hidden += 1
        np.reciprocal(hidden, out=hidden)
        hidden, back = hidden.reshape(units, runs, n), back.reshape(units, runs, n)
        eta = np.matmul(self.second.T[:, None], hidden.transpose(1, 0, 2))[:, 0] + self.last
        small = np.exp(-np.abs(eta))
        self.loss += (weight * (np.maximum(eta, 0) + np.log1p(small) - y * eta)).sum(1)
        off = weight * (np.where(eta < 0, small, 1) / (1 + small) - y)
        # off x hidden, which sums up to the slopes, then off x hidden x (1 - hidden).
        np.multiply(hidden, off, out=back)
        self.slope += back.sum(2)
        np.subtract(1, hidden, out=hidden)
        back *= hidden
        self.grad += back.reshape(-1, n) @ x
        self.off += off.sum(1)

    def gradient(self) -> np.ndarray:
        units, runs = self.second.shape
        first = self.grad.reshape(units, runs, -1) * self.second[:, :, None]
        return np.hstack([first.transpose(1, 2, 0).reshape(runs, -1), self.slope.T, self.off[:, None]])


def loss_and_gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log losses (run) and gradients (run, weights) of rows with truths and weights (row, run)."""
    sums = Sums(theta, x.shape[1], units, np.empty(2 * len(x) * units * len(theta)))
    sums.add(x, np.ascontiguousarray(y.T), np.ascontiguousarray(weight.T))
    return sums.loss, sums.gradient()


def _known(y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Truths without gaps and weights, 0 where the truth is unknown, (outcome, row)."""
    y = np.ascontiguousarray(y.T)
    return np.nan_to_num(y), weight * ~np.isnan(y)


PACKED = "n long, at binary, x binary, rest binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's rows as bytes: every step reads them again, and so need not take lists apart. Of features that
    are mostly 0 the others are kept with their places."""
    for fold, y, weight, x in blocks(batches):
        at = np.flatnonzero(x).astype(np.uint32)
        if 2 * len(at) < x.size:
            found = [at.tobytes(), x.reshape(-1)[at].tobytes()]
        else:
            found = [b"", np.ascontiguousarray(x).tobytes()]
        rest = zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in (fold.astype(np.int64), weight.astype(float), y)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *[pa.array([b], pa.binary()) for b in (*found, rest)]], names=["n", "at", "x", "rest"])


def _kept(n: int, at: bytes, x: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folds, truths, weights, and features as places (none: all) and values."""
    rest = zlib.decompress(rest)
    fold, weight, y = np.frombuffer(rest, np.int64, n), np.frombuffer(rest, float, n, 8 * n), np.frombuffer(rest, float, -1, 16 * n)
    return fold, y.reshape(n, -1), weight, np.frombuffer(at, np.uint32), np.frombuffer(x)


def _whole(at: np.ndarray, x: np.ndarray, n: int, width: int) -> np.ndarray:
    if not len(at):
        return x.reshape(n, width)
    out = np.zeros(n * width)
    out[at] = x
    return out.reshape(n, width)


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What `blocks` gave."""
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            fold, y, weight, at, x = _kept(*row)
            yield fold, y, weight, _whole(at, x, row[0], width)


def _shares(live: list[Run], width: int, units: int) -> list[tuple[list[int], int, np.ndarray]]:
    """(runs, their units, their weights' places) of bounded size: runs with the same units are computed side by side, without those
    units that they lack."""
    by_units: dict[int, list[int]] = {}
    for i, r in enumerate(live):
        by_units.setdefault(r.units, []).append(i)
    out = []
    for mine, runs in sorted(by_units.items()):
        step, places = max(1, min(RUNS, COLUMNS // mine)), np.flatnonzero(_used(width, units, mine))
        out += [(runs[i : i + step], mine, places) for i in range(0, len(runs), step)]
    return out


def _scan(theta: np.ndarray, live: list[Run], units: int):
    """A task's share of the losses and gradients of all runs."""
    outcome, left_out = np.array([r.outcome for r in live]), np.array([r.fold for r in live])
    width = (theta.shape[1] - 1) // units - 1
    shares = [(runs, mine, places, outcome[runs], left_out[runs], theta[np.ix_(runs, places)]) for runs, mine, places in _shares(live, width, units)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(2 * ROWS_AT_ONCE * max(COLUMNS, units))
        sums = [Sums(at, width, mine, room) for _, mine, _, _, _, at in shares]
        empty = True
        for fold, y, weight, x in _packed(batches, width):
            empty = False
            y, weight = _known(y, weight)
            for total, (_, _, _, outcomes, folds, _) in zip(sums, shares):
                total.add(x, y[outcomes], weight[outcomes] * (fold != folds[:, None]))
        if not empty:
            found = [(i, t.tobytes()) for total, (runs, *_) in zip(sums, shares) for i, t in zip(runs, np.hstack([total.loss[:, None], total.gradient()]))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["run", "data"])

    return each


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"run": [pdf["run"].iloc[0]], "data": [sum(np.frombuffer(d) for d in pdf["data"]).tobytes()]})


def summed(narrow: DataFrame, tasks: int, scan, size: int) -> list[np.ndarray]:
    """Sums by run of what `scan` yields, of `size` bytes a task."""
    found = narrow.mapInArrow(scan, "run long, data binary")
    if tasks * size > DIRECT_BYTES:
        part = F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks**0.5))))
        found = found.withColumn("part", part).groupBy("run", "part").applyInPandas(_add, "run long, data binary")
        found = found.groupBy("run").applyInPandas(_add, "run long, data binary")
    sums: dict[int, np.ndarray] = {}
    for row in found.toLocalIterator() if tasks * size > DIRECT_BYTES else found.collect():
        sums[row["run"]] = sums.get(row["run"], 0) + np.frombuffer(row["data"])
    if not sums:
        raise ValueError("no rows to fit on")
    return [sums[k] for k in sorted(sums)]


@dataclass
class Descent:
    """One run's way down: a limited-memory quasi-Newton step, shortened until the loss falls enough."""

    at: np.ndarray
    epochs: int
    tol: float
    value: float = np.inf
    grad: np.ndarray | None = None
    move: np.ndarray | None = None
    share: float = 1.0
    done: bool = False
    steps: int = 0
    memory: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def trial(self) -> np.ndarray:
        return self.at if self.move is None else self.at + self.share * self.move

    def _direction(self) -> np.ndarray:
        q, used = self.grad.copy(), []
        for s, y in reversed(self.memory):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.memory:
            s, y = self.memory[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(self.memory, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def tell(self, value: float, grad: np.ndarray) -> None:
        """Loss and gradient at the trial point."""
        if self.move is not None:
            slope = self.grad @ self.move
            if not value <= self.value + LESS * self.share * slope:
                curve = value - self.value - self.share * slope
                best = -slope * self.share / (2 * curve) if np.isfinite(curve) and curve > 0 else 0.1
                self.share *= float(np.clip(best, 0.1, 0.5))
                if self.share < SURE:  # no step along a restarted direction helps: this is the lowest point within rounding
                    if not self.memory:
                        self.done = True
                    self.memory, self.share = [], 1.0
                    self.move = self._direction()
                return
            step, change = self.share * self.move, grad - self.grad
            if step @ change > 1e-12 * np.linalg.norm(step) * np.linalg.norm(change):
                self.memory = [*self.memory[1 - MEMORY :], (step, change)]
            self.steps += 1
            self.done = self.steps >= self.epochs or self.value - value <= self.tol * (abs(value) + self.tol)
            self.at = self.at + step
        self.value, self.grad = value, grad
        self.move, self.share = self._direction(), 1.0
        if self.grad @ self.move >= 0:
            self.memory = []
            self.move = self._direction()
        self.done |= not np.any(self.grad)


def _spread(runs: list[Run], tasks: int) -> list[list[int]]:
    """Shares of runs with the same units, two or more a task if there are enough runs, the longest first."""
    most = sum(r.units for r in runs) // (2 * tasks)
    by_units: dict[int, list[int]] = {}
    for i, r in sorted(enumerate(runs), key=lambda ir: -ir[1].epochs):  # runs of a share end together
        by_units.setdefault(r.units, []).append(i)
    out = []
    for units, mine in by_units.items():
        parts = -(-len(mine) // max(1, min(RUNS, COLUMNS // units, most // units)))
        out += [mine[len(mine) * i // parts : len(mine) * (i + 1) // parts] for i in range(parts)]
    return sorted(out, key=lambda share: -sum(runs[i].epochs * runs[i].units for i in share))


def follow(held: list[tuple], runs: list[Run], start: np.ndarray, tol: float) -> list[Descent]:
    """Runs with the same units, from start weights to their ends over the rows that are held."""
    units = runs[0].units
    width = (len(start) - 1) // units - 1
    ways, room = [Descent(start, r.epochs, tol) for r in runs], np.empty(2 * ROWS_AT_ONCE * units * len(runs))
    while live := [i for i, way in enumerate(ways) if not way.done]:
        theta = np.stack([ways[i].trial() for i in live])
        outcome, left_out = np.array([runs[i].outcome for i in live]), np.array([runs[i].fold for i in live])
        sums = Sums(theta, width, units, room)
        for fold, y, weight, at, x in held:
            sums.add(_whole(at, x, len(fold), width), y[outcome], weight[outcome] * (fold != left_out[:, None]))
        for i, at, value, grad in zip(live, theta, sums.loss, sums.gradient()):
            ways[i].tell(value + runs[i].penalty * (at @ at), grad + 2 * runs[i].penalty * at)
    return ways


def _followed(packed: DataFrame, runs: list[Run], shares: list[list[int]], start: Mapping[int, np.ndarray], tol: float) -> list[Descent]:
    """All runs at their ends: a task for each share, which gets all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for share, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                fold, y, weight, *x = _kept(*row)
                held.setdefault(share, []).append((fold, *_known(y, weight), *x))
        for share in list(held):
            mine = shares[share]
            ways = follow(held.pop(share), [runs[i] for i in mine], start[runs[mine[0]].units], tol)
            data = [np.concatenate([way.at, [way.value, way.steps]]).tobytes() for way in ways]
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(data, pa.binary())], names=["run", "data"])

    numbers = packed.sparkSession.range(0, len(shares), 1, len(shares)).withColumnRenamed("id", "share")
    found = numbers.crossJoin(F.broadcast(packed)).mapInArrow(each, "run long, data binary").collect()
    ends = {r["run"]: np.frombuffer(r["data"]) for r in found}
    return [Descent(ends[i][:-2], r.epochs, tol, value=float(ends[i][-2]), steps=int(ends[i][-1]), done=True) for i, r in enumerate(runs)]


def predictions(rows: DataFrame, id_col: str, fold: str | None, features: str, outcomes: list[str], configs: int, runs: Sequence, odds: Callable) -> DataFrame:
    """(outcome, config, fold, id, truth, pred, p0, p1) of a joint fit; `odds` gives the log odds of rows by runs."""
    at = {(r.fold, r.outcome, r.config): i for i, r in enumerate(runs)}
    cells = [(o, c) for o in range(len(outcomes)) for c in range(configs)]
    truths = [F.lit(None).cast("double") if fold is None else F.col(f"`{o}`").cast("double") for o in outcomes]
    held = F.lit(-1) if fold is None else F.col(fold)
    narrow = rows.select(held.cast("long").alias("_f"), F.array(*truths).alias("_y"), F.lit(1.0).alias("_w"), feature_array(rows, features).alias("_x"), F.col(id_col).alias("_id"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for folds, _, _, x in blocks(iter([batch])):
                p = np.empty((len(x), len(cells)))
                for f in np.unique(folds).tolist():
                    mine = folds == f
                    p[mine] = _logistic(odds([at[f, *cell] for cell in cells], x[mine]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(cells)), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(start, len(x)) for i in (4, 0, 1)], lists], names=["id", "fold", "y", "p"])
                start += len(x)

    id_type = rows.schema[id_col].dataType.simpleString()
    wide = narrow.filter(F.col("_x").isNotNull()).mapInArrow(each, f"id {id_type}, fold long, y array<double>, p array<double>")
    cell = wide.select("id", "fold", "y", F.posexplode("p").alias("k", "p1"))
    place = F.floor(F.col("k") / configs).cast("int")
    return cell.select(
        F.get(F.array(*[F.lit(o) for o in outcomes]), place).alias("outcome"), F.format_string("Model%02d", F.col("k") % configs + 1).alias("config"), "fold", "id",
        F.get("y", place).cast("int").alias("truth"), (F.col("p1") > 0.5).cast("int").alias("pred"), (1 - F.col("p1")).alias("p0"), "p1",
    )


def with_shares(df: DataFrame, features: str, odds: Callable) -> DataFrame:
    """Add `p0`, `p1` and `pred` from the log odds of rows; NULL without features."""

    @F.pandas_udf("double")
    def share(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        known = x.notna().to_numpy()
        if known.any():
            values = np.stack(x[known].tolist()).astype(float)
            out[known] = _logistic(odds(np.hstack([np.ones((len(values), 1)), values])))
        return pd.Series(out).astype(object).where(known, None)

    out = df.withColumn("p1", share(feature_array(df, features)))
    return out.withColumn("p0", 1 - F.col("p1")).withColumn("pred", (F.col("p1") > 0.5).cast("int"))


@dataclass
class Networks:
    """Weights (run, width * units + units + 1); runs with fewer units have zeros in the others."""

    outcomes: list[str]
    configs: list[dict]
    runs: list[Run]
    units: int
    theta: np.ndarray
    value: np.ndarray  # penalised loss
    steps: np.ndarray

    def predict(self, rows: DataFrame, id_col: str = "id", fold: str | None = "fold", features: str = "features") -> DataFrame:
        """(outcome, config, fold, id, truth, pred, p0, p1): each row by the runs that left its fold out, or by those that saw
        all folds (`fold=None`; truth is then NULL). `config` numbers the parameter sets from 1. Row by row."""
        theta, units = self.theta, self.units
        return predictions(rows, id_col, fold, features, self.outcomes, len(self.configs), self.runs, lambda at, x: forward(theta[at], x, units)[1])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add `p0`, `p1` and `pred` of the only run. Rows without features get NULL."""
        if len(self.runs) != 1:
            raise ValueError("several runs: use `predict`")
        theta, units = self.theta, self.units
        return with_shares(df, features, lambda x: forward(theta, x, units)[1][:, 0])

    def save(self, path: str) -> None:
        keep = [(json.dumps({"outcomes": self.outcomes, "configs": self.configs, "units": self.units}), [asdict(r) for r in self.runs], self.theta.tolist(), self.value.tolist(), self.steps.tolist())]
        run = "outcome:int,config:int,units:int,penalty:double,epochs:int,fold:int"
        schema = f"meta string, runs array<struct<{run}>>, theta array<array<double>>, value array<double>, steps array<int>"
        SparkSession.active().createDataFrame(keep, schema).coalesce(1).write.mode("overwrite").parquet(path + "/networks")

    @staticmethod
    def load(path: str) -> Networks:
        row = SparkSession.active().read.parquet(path + "/networks").first()
        runs = [Run(**r.asDict()) for r in row["runs"]]
        return Networks(**json.loads(row["meta"]), runs=runs, theta=np.array(row["theta"]), value=np.array(row["value"]), steps=np.array(row["steps"]))


def fit_networks(
    rows: DataFrame, outcomes: Sequence[str], configs: Sequence[Mapping[str, object]], v: int = 0, fold: str = "fold", features: str = "features",
    weight: str | None = None, tol: float = 1e-8, seed: int = 100, tasks: int | None = None,
) -> Networks:
    """Fit every outcome (0/1, NULL where unknown) with every parameter set on all rows and without each of the folds 0 to v - 1.

    A parameter set has `hidden_units` (5), `penalty` (0) and `epochs` (100), the most steps that are taken. Minimised is the sum of
    weight x log loss plus penalty x the sum of all squared weights, biases included; logistic units, start weights from
    `seed`. A weight counts like that many copies of the row; NULL is 0. Rows without features are left out,
    missing values among them are 0. `tol` is the relative fall of the loss at which a run ends. Python on the driver
    holds no rows or labels, but the weights of all runs and the last steps of each, sizes that the parameters set.
    Packed rows of up to `HELD_BYTES` (measured) are broadcast if there are runs for all tasks.
    """
    outcomes, configs = list(outcomes), [dict(c) for c in configs]
    held = F.col(fold).cast("long") if v else F.lit(0).cast("long")
    heavy = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    narrow = rows.select(
        held.alias("_f"), F.array(*[F.col(f"`{o}`").cast("double") for o in outcomes]).alias("_y"), heavy.alias("_w"), feature_array(rows, features).alias("_x")
    ).filter(F.col("_x").isNotNull())
    narrow = settle(narrow, "network-rows", even=True)
    first = narrow.first()
    if first is None:
        raise ValueError("no rows to fit on")
    width = len(first["_x"]) + 1
    units = max(int(c.get("hidden_units", 5)) for c in configs)
    runs = [
        Run(o, k, int(c.get("hidden_units", 5)), float(c.get("penalty", 0.0)), int(c.get("epochs", 100)), f)
        for o in range(len(outcomes)) for k, c in enumerate(configs) for f in (-1, *range(v))
    ]
    if tasks is None:  # some thousand rows of one run are work for a task
        tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, narrow.count() * len(runs) // (32 * ROWS_AT_ONCE)))
    parts = narrow.rdd.getNumPartitions()
    if parts < tasks:
        narrow = settle(narrow.repartition(tasks, F.xxhash64("_x")), "network-rows")
    tasks = max(tasks, parts)
    # Each task sends the sums of all runs, so that there are no more tasks than can run at once.
    tasks = min(tasks, max(1, rows.sparkSession.sparkContext.defaultParallelism))
    narrow = settle(narrow.coalesce(tasks).mapInArrow(_pack, PACKED), "network-blocks")
    used = {r.units: _used(width, units, r.units) for r in runs}
    start = np.random.default_rng(seed).uniform(-START, START, width * units + units + 1)
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    shares = _spread(runs, parallel)
    if len(shares) >= parallel and narrow.agg(F.sum(F.length("at") + F.length("x") + F.length("rest"))).first()[0] <= HELD_BYTES:
        ways = _followed(narrow, runs, shares, {n: start[places] for n, places in used.items()}, tol)
        theta = np.zeros((len(runs), len(start)))
        for at, way, r in zip(theta, ways, runs):
            at[used[r.units]] = way.at
    else:
        ways = [Descent(np.where(used[r.units], start, 0.0), r.epochs, tol) for r in runs]
        _step_by_step(narrow, tasks, runs, ways, used, units)
        theta = np.stack([way.at for way in ways])
    return Networks(outcomes, configs, runs, units, theta, np.array([w.value for w in ways]), np.array([w.steps for w in ways]))


def _step_by_step(packed: DataFrame, tasks: int, runs: list[Run], ways: list[Descent], used: Mapping[int, np.ndarray], units: int) -> None:
    """All runs to their ends, a scan of the rows for each step."""
    while live := [i for i, way in enumerate(ways) if not way.done]:
        theta = np.stack([ways[i].trial() for i in live])
        size = 8 * sum(int(used[runs[i].units].sum()) + 1 for i in live)
        sums = summed(packed, tasks, _scan(theta, [runs[i] for i in live], units), size)
        for i, at, total in zip(live, theta, sums):
            mine = used[runs[i].units]
            grad = np.zeros(len(at))
            grad[mine] = total[1:] + 2 * runs[i].penalty * at[mine]
            ways[i].tell(total[0] + runs[i].penalty * (at @ at), grad)


def _used(width: int, units: int, mine: int) -> np.ndarray:
    """Which weights a run with `mine` of the units has."""
    unit = np.arange(units) < mine
    return np.concatenate([np.tile(unit, width), unit, [True]])
