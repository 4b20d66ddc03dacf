"""Second-order boosted trees: all runs (outcome x parameters x fold) grow their trees together, level by level.

Features are cut into bins at exact quantiles once. For each level one scan sums gradients and second derivatives per
node, feature and bin, of the lighter child only: its sibling is the parent's histogram less that. Sums are whole numbers (units of
2^-24), so neither the order of the tasks nor the subtraction changes a split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabel.operators.ranking import running_totals
from textlabel.plans.network import blocks, feature_array, predictions, with_shares
from textlabel.session import settle

UNIT = 2.0**24
ROWS_AT_ONCE = 8192
# Trees are walked by so many rows at a time, whose places in all runs' trees fit the processor's cache.
ROWS_IN_CACHE = 128
# A scan fills histograms of this size at most; more runs take more scans.
SCAN_BYTES = 128 << 20
# Up to this size the histograms of a level are added and split on the driver, beyond it on the executors.
DIRECT_BYTES = 64 << 20
# After so many trees the log odds of the rows are written down, so that a scan never walks more trees than that.
TREES_BETWEEN = 8


@dataclass(frozen=True)
class Run:
    outcome: int
    config: int
    fold: int
    trees: int
    depth: int
    learn_rate: float
    penalty: float
    min_n: float
    min_gain: float
    mtry: float


@dataclass(frozen=True)
class Split:
    """A node's best split, `feature` -1 where none pays; sums of gradients and second derivatives of all and of the left."""

    run: int
    node: int
    feature: int
    bin: int
    gain: float
    g: float
    h: float
    g_left: float
    h_left: float


def best_split(hist: np.ndarray, run: int, node: int, rule: Run, features: np.ndarray) -> Split:
    """Of a histogram (2, feature, bin) of whole numbers; the first of equal gains in order of feature and bin."""
    total = hist[:, 0, :].sum(1) / UNIT
    left = np.cumsum(hist, 2)[:, :, :-1] / UNIT
    g, h = total
    right_g, right_h = g - left[0], h - left[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + rule.penalty) + right_g**2 / (right_h + rule.penalty) - g**2 / (h + rule.penalty)
    # A side without rows is no side, whatever `min_n` is.
    ok = (left[1] >= rule.min_n) & (right_h >= rule.min_n) & (left[1] > 0) & (right_h > 0) & np.isfinite(gain)
    ok[~features] = False
    gain = np.where(ok, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    if not gain.size or not gain[f, b] > max(rule.min_gain, 1e-9):
        return Split(run, node, -1, 0, 0.0, float(g), float(h), 0.0, 0.0)
    return Split(run, node, int(f), int(b), float(gain[f, b]), float(g), float(h), float(left[0][f, b]), float(left[1][f, b]))


def allowed(seed: int, run: int, tree: int, node: int, share: float, width: int) -> np.ndarray:
    """Which features a node may use: a share of them, drawn anew for each node."""
    out = np.zeros(width, bool)
    out[np.random.default_rng([seed, run, tree, node]).permutation(width)[: max(1, int(np.ceil(share * width)))]] = True
    return out


def leaves(feature: np.ndarray, cut: np.ndarray, codes: np.ndarray, levels: int) -> np.ndarray:
    """Node (row, run) that each row reaches in the trees (run, node); the children of i are 2 i + 1 and 2 i + 2."""
    if len(codes) > ROWS_IN_CACHE:
        return np.concatenate([leaves(feature, cut, codes[i : i + ROWS_IN_CACHE], levels) for i in range(0, len(codes), ROWS_IN_CACHE)])
    at = np.zeros((len(codes), len(feature)), int)
    # Places in the flat arrays; a leaf reads feature 0, which changes nothing.
    run, row = (np.arange(len(feature)) * feature.shape[1])[None, :], (np.arange(len(codes)) * codes.shape[1])[:, None]
    inner, used, cut, codes = (feature >= 0).ravel(), np.maximum(feature, 0).ravel(), cut.ravel(), codes.ravel()
    for _ in range(levels):
        place = run + at
        go = inner.take(place)
        if not go.any():
            break
        at += go * (at + 1 + (codes.take(row + used.take(place)) > cut.take(place)))
    return at


def common_bins(codes: np.ndarray, bins: int) -> np.ndarray:
    """The most frequent bin of each feature among the rows."""
    width = codes.shape[1]
    return np.bincount((np.arange(width) * bins + codes).ravel(), minlength=width * bins).reshape(width, bins).argmax(1)


@dataclass
class Trees:
    """(tree, run, node): feature or -1, bin, and value of the leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def odds(self, codes: np.ndarray, levels: int) -> np.ndarray:
        out = np.zeros((len(codes), self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.bin, self.value):
            out += value[np.arange(value.shape[0])[None, :], leaves(feature, cut, codes, levels)]
        return out

    def of(self, runs: Sequence[int]) -> Trees:
        return Trees(self.feature[:, runs], self.bin[:, runs], self.value[:, runs])

    def between(self, first: int, last: int) -> Trees:
        return Trees(self.feature[first:last], self.bin[first:last], self.value[first:last])


def to_codes(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Bins (row, feature): the number of cuts below the value."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def feature_cuts(narrow: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but the last, at exact quantiles of counted distinct values."""
    cells = narrow.select(F.posexplode("_x").alias("dim", "v"))
    # 0 and -0 are one value.
    counts = settle(cells.groupBy("dim", (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    total = F.broadcast(counts.groupBy("dim").agg(F.sum("n").alias("total")))  # one row a feature
    runs = running_totals(counts, "v", ["n"], ["dim"], cached=True).join(total, "dim")
    place = F.floor((F.col("cum_n") - 1) * bins / F.col("total"))
    ends = runs.groupBy("dim", place.alias("place")).agg(F.max("v").alias("v"))
    out: list[list[float]] = [[] for _ in range(width)]
    for row in ends.collect():  # at most `bins` a feature
        out[row["dim"]].append(row["v"])
    return [np.array(sorted(values)[:-1]) for values in out]


@dataclass
class Boosted:
    outcomes: list[str]
    configs: list[dict]
    runs: list[Run]
    cuts: list[np.ndarray]
    trees: Trees
    splits: list[Split]  # of the first tree of each run

    @property
    def levels(self) -> int:
        return max(r.depth for r in self.runs)

    def _odds(self, x: np.ndarray, runs: Sequence[int]) -> np.ndarray:
        return self.trees.of(list(runs)).odds(to_codes(self.cuts, x[:, 1:]), self.levels)

    def predict(self, rows: DataFrame, id_col: str = "id", fold: str | None = "fold", features: str = "features") -> DataFrame:
        """(outcome, config, fold, id, truth, pred, p0, p1): each row by the runs that left its fold out, or by those that saw
        all folds (`fold=None`; truth is then NULL). `config` numbers the parameter sets from 1. Row by row."""
        return predictions(rows, id_col, fold, features, self.outcomes, len(self.configs), self.runs, lambda at, x: self._odds(x, at))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add `p0`, `p1` and `pred` of the only run. Rows without features get NULL."""
        if len(self.runs) != 1:
            raise ValueError("several runs: use `predict`")
        return with_shares(df, features, lambda x: self._odds(x, [0])[:, 0])

    def importance(self) -> np.ndarray:
        """How many splits use each feature."""
        return np.bincount(self.trees.feature[self.trees.feature >= 0], minlength=len(self.cuts))

    def save(self, path: str) -> None:
        meta = {
            "outcomes": self.outcomes, "configs": self.configs, "runs": [asdict(r) for r in self.runs], "cuts": [c.tolist() for c in self.cuts],
            "trees": {k: v.tolist() for k, v in vars(self.trees).items()}, "splits": [asdict(s) for s in self.splits],
        }
        SparkSession.active().createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").parquet(path + "/boosted")

    @staticmethod
    def load(path: str) -> Boosted:
        m = json.loads(SparkSession.active().read.parquet(path + "/boosted").first()["value"])
        trees = Trees(**{k: np.array(v) for k, v in m["trees"].items()})
        return Boosted(m["outcomes"], m["configs"], [Run(**r) for r in m["runs"]], [np.array(c) for c in m["cuts"]], trees, [Split(**s) for s in m["splits"]])


def _coded(cuts: list[np.ndarray]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [to_codes(cuts, x[:, 1:]) for _, _, _, x in blocks(iter([batch]), ROWS_AT_ONCE)]
            codes = [row.tobytes() for part in x for row in part]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(codes, pa.binary()), pa.array([b""] * len(codes), pa.binary())], names=["_f", "_y", "_w", "_c", "_m"])

    return each


CODED = "_f long, _y array<double>, _w double, _c binary, _m binary"


def _parts(batches: Iterator[pa.RecordBatch], width: int, runs: int):
    """(folds, truths, weights, codes, log odds written down so far) of some thousand rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            n = part.num_rows
            y = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(n, width)
            kept = b"".join(part.column(4).to_pylist())
            odds = np.frombuffer(kept).reshape(n, runs) if kept else np.zeros((n, runs))
            yield part, part.column(0).to_numpy(zero_copy_only=False), y, part.column(2).to_numpy(zero_copy_only=False), codes, odds


def _histograms(runs: list[Run], mine: list[int], wanted: list[tuple[int, int]], before: Trees, now: Trees, width: int, bins: int, levels: int):
    """A task's histograms of the wanted nodes (run, node)."""
    slots = {r: {node: i for i, node in enumerate(node for run, node in wanted if run == r)} for r in mine}
    outcome, left_out = [runs[r].outcome for r in mine], np.array([runs[r].fold for r in mine])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, fold, y, weight, codes, odds in _parts(batches, width, len(runs)):
            odds = odds[:, mine] + before.of(mine).odds(codes, levels)
            y = y[:, outcome]
            inside = weight[:, None] * (~np.isnan(y) & (fold[:, None] != left_out[None, :]))
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            g, h = np.rint(inside * (p - np.nan_to_num(y)) * UNIT), np.rint(inside * p * (1 - p) * UNIT)
            at = leaves(now.feature[0][mine], now.bin[0][mine], codes, levels)
            # Only cells outside a feature's most frequent bin are counted, as a rule few; that bin has the rest of each node's sum.
            common = common_bins(codes, bins)
            holder, column = np.nonzero(codes != common)
            cell = column * bins + codes[holder, column]
            for k, r in enumerate(mine):
                slot = np.full(now.feature.shape[2], -1)
                slot[list(slots[r])] = list(slots[r].values())
                place = slot[at[:, k]]
                wanted_row = (place >= 0) & (inside[:, k] > 0)
                rows, cells = np.flatnonzero(wanted_row), np.flatnonzero(wanted_row[holder])
                owner, many = holder[cells], len(slots[r])
                key = place[owner] * (width * bins) + cell[cells]
                part = np.zeros((2, many, width, bins), np.int64)
                for i, v in enumerate((np.ascontiguousarray(g[:, k]), np.ascontiguousarray(h[:, k]))):
                    part[i] = np.bincount(key, v[owner], many * width * bins).astype(np.int64).reshape(many, width, bins)
                    total = np.bincount(place[rows], v[rows], many).astype(np.int64)
                    part[i][:, np.arange(width), common] += total[:, None] - part[i].sum(2)
                sums[r] = sums.get(r, 0) + part.reshape(2, -1)
        found = [(r, node, total[:, i * width * bins : (i + 1) * width * bins].tobytes()) for r, total in sums.items() for node, i in slots[r].items()]
        if found:
            r, node, data = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(node, pa.int64()), pa.array(data, pa.binary())], names=["run", "node", "data"])

    return each


def _total(data: Sequence[bytes]) -> np.ndarray:
    return sum(np.frombuffer(d, np.int64) for d in data)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"run": pdf["run"].iloc[:1], "node": pdf["node"].iloc[:1], "data": [_total(pdf["data"]).tobytes()]})


HISTOGRAM = "run long, node long, data binary"
SPLIT = "feature int, bin int, gain double, g double, h double, g_left double, h_left double"


def fit_boosted(
    rows: DataFrame, outcomes: Sequence[str], configs: Sequence[Mapping[str, object]], v: int = 0, fold: str = "fold", features: str = "features",
    weight: str | None = None, bins: int = 64, seed: int = 100, tasks: int | None = None,
) -> Boosted:
    """Boost every outcome (0/1, NULL where unknown) with every parameter set on all rows and without each of the folds 0 to v - 1.

    A parameter set has `trees` (15), `depth` (6), `learn_rate` (0.3), `penalty` on squared leaf values (1), `min_n`, the least
    sum of second derivatives on each side (1), `loss_reduction`, the least gain (0), and `mtry`, the share of features a
    node may use (1). Up to 256 `bins` a feature. A weight counts like that many copies of the row; NULL is 0. Rows without
    features are left out, missing values among them are 0. The driver holds cuts and trees, whose size the parameters set.
    """
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    outcomes, configs = list(outcomes), [dict(c) for c in configs]
    held = F.col(fold).cast("long") if v else F.lit(0).cast("long")
    heavy = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    narrow = rows.select(held.alias("_f"), F.array(*[F.col(f"`{o}`").cast("double") for o in outcomes]).alias("_y"), heavy.alias("_w"), feature_array(rows, features).alias("_x"))
    narrow = settle(narrow.filter(F.col("_x").isNotNull()), "boosting-rows", even=True)
    first = narrow.first()
    if first is None:
        raise ValueError("no rows to fit on")
    width = len(first["_x"])
    runs = [
        Run(o, k, f, int(c.get("trees", 15)), int(c.get("depth", 6)), float(c.get("learn_rate", 0.3)), float(c.get("penalty", 1.0)), float(c.get("min_n", 1.0)), float(c.get("loss_reduction", 0.0)), float(c.get("mtry", 1.0)))
        for o in range(len(outcomes)) for k, c in enumerate(configs) for f in (-1, *range(v))
    ]
    if tasks is None:  # some thousand rows of one run are work for a task
        tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, narrow.count() * len(runs) // ROWS_AT_ONCE))
    cuts = feature_cuts(narrow, width, bins)
    spread = narrow if narrow.rdd.getNumPartitions() >= tasks else narrow.repartition(tasks, F.xxhash64("_x"))
    coded = settle(spread.mapInArrow(_coded(cuts), CODED), "boosting-codes")
    parts = coded.rdd.getNumPartitions()
    count, levels = max(r.trees for r in runs), max(r.depth for r in runs)
    shape = count, len(runs), 2 ** (levels + 1) - 1
    trees = Trees(np.full(shape, -1), np.zeros(shape, int), np.zeros(shape))
    firsts: list[Split] = []
    written = 0
    for t in range(count):
        if t - written == TREES_BETWEEN:
            coded = _written(coded, trees.between(written, t), width, len(runs), levels)
            written = t
        grower = _Level(coded, runs, trees.between(written, t), trees.between(t, t + 1), width, bins, levels, seed, t, parts)
        wanted = [(r, 0) for r, run in enumerate(runs) if run.trees > t]
        for level in range(levels):
            found = grower.splits(wanted)
            wanted = []
            for s in found:
                run = runs[s.run]
                if level == 0:
                    trees.value[t, s.run, 0] = -run.learn_rate * s.g / (s.h + run.penalty) if s.h + run.penalty > 0 else 0.0
                if t == 0:
                    firsts.append(s)
                if s.feature < 0:
                    continue
                trees.feature[t, s.run, s.node], trees.bin[t, s.run, s.node] = s.feature, s.bin
                for child, g, h in ((2 * s.node + 1, s.g_left, s.h_left), (2 * s.node + 2, s.g - s.g_left, s.h - s.h_left)):
                    trees.value[t, s.run, child] = -run.learn_rate * g / (h + run.penalty)
                if level + 1 < run.depth:
                    wanted.append((s.run, 2 * s.node + (1 if 2 * s.h_left <= s.h else 2)))
            if not wanted:
                break
    return Boosted(outcomes, configs, runs, cuts, trees, firsts)


def _written(coded: DataFrame, trees: Trees, width: int, runs: int, levels: int) -> DataFrame:
    """The rows with the log odds of some more trees added to what is written."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, _, codes, odds in _parts(batches, width, runs):
            now = odds + trees.odds(codes, levels)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(4)], pa.array([row.tobytes() for row in now], pa.binary())], names=["_f", "_y", "_w", "_c", "_m"])

    return settle(coded.mapInArrow(each, CODED), "boosting-odds")


@dataclass
class _Level:
    """The levels of one tree of each run. Holds the histograms of the level before, here or in a table."""

    coded: DataFrame
    runs: list[Run]
    before: Trees
    now: Trees
    width: int
    bins: int
    levels: int
    seed: int
    tree: int
    parts: int
    held: dict[tuple[int, int], np.ndarray] | None = None
    stored: DataFrame | None = None

    def _resolve(self, run: int, node: int, light: np.ndarray, parent: np.ndarray | None) -> list[tuple[Split, np.ndarray]]:
        """Splits and histograms of a node and, by subtraction from the parent, of its sibling."""
        both = [(node, light)] if parent is None else [(node, light), (node + 1 if node % 2 else node - 1, parent - light)]
        out = []
        for at, hist in both:
            free = allowed(self.seed, run, self.tree, at, self.runs[run].mtry, self.width)
            out.append((best_split(hist.reshape(2, self.width, self.bins), run, at, self.runs[run], free), hist))
        return out

    def splits(self, wanted: list[tuple[int, int]]) -> list[Split]:
        """Best splits of the wanted nodes and their siblings."""
        one = 2 * self.width * self.bins * 8
        groups, size = [[]], 0
        for r in sorted({r for r, _ in wanted}):
            mine = one * sum(1 for run, _ in wanted if run == r)
            if groups[-1] and size + mine > SCAN_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(r)
            size += mine
        found = None
        for mine in groups:
            nodes = [w for w in wanted if w[0] in set(mine)]
            scan = self.coded.mapInArrow(_histograms(self.runs, mine, nodes, self.before, self.now, self.width, self.bins, self.levels), HISTOGRAM)
            found = scan if found is None else found.unionByName(scan)
        if self.stored is None and len(wanted) * one * (self.parts + 2) <= DIRECT_BYTES:
            return self._here(wanted, found)
        return self._there(wanted, found)

    def _here(self, wanted: list[tuple[int, int]], found: DataFrame) -> list[Split]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for row in found.collect():
            key = row["run"], row["node"]
            sums[key] = sums.get(key, 0) + np.frombuffer(row["data"], np.int64)
        empty = np.zeros(2 * self.width * self.bins, np.int64)
        out = []
        for run, node in wanted:
            out += self._resolve(run, node, sums.get((run, node), empty), self.held[run, (node - 1) // 2] if node else None)
        self.held = {(s.run, s.node): hist for s, hist in out}
        return [s for s, _ in out]

    def _there(self, wanted: list[tuple[int, int]], found: DataFrame) -> list[Split]:
        spark = self.coded.sparkSession
        if self.stored is None and self.held is not None:  # at most DIRECT_BYTES
            held = [(r, n, bytearray(h.tobytes())) for (r, n), h in self.held.items()]
            self.stored, self.held = spark.createDataFrame(held, HISTOGRAM), None
        if self.parts > 64:  # many tasks: add them by parts first, so that no group grows with them
            part = F.pmod(F.spark_partition_id(), F.lit(int(self.parts**0.5)))
            found = found.withColumn("part", part).groupBy("run", "node", "part").applyInPandas(_add, HISTOGRAM)
        parent = F.when(F.col("node") == 0, F.lit(-1)).otherwise(F.floor((F.col("node") - 1) / 2)).cast("long")
        fresh = found.select("run", parent.alias("above"), "node", "data")
        if self.stored is not None:
            asked = spark.createDataFrame([(r, (n - 1) // 2) for r, n in wanted], "run long, above long")
            old = self.stored.select("run", F.col("node").alias("above"), F.lit(None).cast("long").alias("node"), "data").join(F.broadcast(asked), ["run", "above"])
            fresh = fresh.unionByName(old)
        resolve = replace(self, coded=None, stored=None, held=None, before=None, now=None)._resolve

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            old = pdf["node"].isna()
            above = _total(pdf.loc[old, "data"]) if old.any() else None
            new = pdf[~old]
            out = resolve(int(pdf["run"].iloc[0]), int(new["node"].iloc[0]), _total(new["data"]), above) if len(new) else []
            return pd.DataFrame([{**asdict(s), "data": hist.tobytes()} for s, hist in out], columns=["run", "node", "data", "feature", "bin", "gain", "g", "h", "g_left", "h_left"])

        self.stored = settle(fresh.groupBy("run", "above").applyInPandas(solve, f"{HISTOGRAM}, {SPLIT}"), "histograms")
        return [Split(**r.asDict()) for r in self.stored.drop("data").sort("run", "node").collect()]
