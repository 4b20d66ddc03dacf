"""Boosted trees against a plain version that tries every cut, weights as copies, and the ways of adding histograms."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlabel.plans import boosting
from textlabel.session import new_table_path

SCHEMA = "id long, fold long, w int, features array<double>, y int, z int"
CONFIG = {"trees": 4, "depth": 3, "learn_rate": 0.3, "penalty": 1.0, "min_n": 1.0}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(300, 4)) / 4
    y = ((x[:, 0] > 1) ^ (x[:, 1] > 1.5) ^ (rng.random(300) < 0.1)).astype(int)
    z = (x[:, 2] + rng.normal(size=300) > 1.5).astype(int)
    return [(i, i % 3, int(rng.integers(0, 4)), x[i].tolist(), int(y[i]), None if i % 11 == 0 else int(z[i])) for i in range(300)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain(x, y, config, weight=None):
    """Log odds of the rows, and the gain of the first cut, by trying every value of every feature."""
    weight = np.ones(len(y)) if weight is None else weight
    odds, gains = np.zeros(len(y)), []

    def value(g, h):
        return g * g / (h + config["penalty"])

    def grow(at, g, h, depth):
        best = (1e-9, None)
        for j in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[at, j])[:-1]:
                left = at & (x[:, j] <= cut)
                right = at & ~left
                if min(h[left].sum(), h[right].sum()) < config["min_n"]:
                    continue
                gain = value(g[left].sum(), h[left].sum()) + value(g[right].sum(), h[right].sum()) - value(g[at].sum(), h[at].sum())
                if gain > best[0] + 1e-5:
                    best = (gain, (left, right))
        if depth == config["depth"]:
            gains.append(best[0])
        if best[1] is None:
            step[at] = -config["learn_rate"] * g[at].sum() / (h[at].sum() + config["penalty"])
            return
        for side in best[1]:
            grow(side, g, h, depth - 1)

    for _ in range(config["trees"]):
        p = 1 / (1 + np.exp(-odds))
        step = np.zeros(len(y))
        grow(np.ones(len(y), bool), weight * (p - y), weight * p * (1 - p), config["depth"])
        odds = odds + step
    return odds, gains


def arrays(data, outcome):
    kept = [r for r in data if r[outcome] is not None]
    return np.array([r[3] for r in kept]), np.array([r[outcome] for r in kept]), np.array([r[0] for r in kept])


def test_equals_trying_every_cut(rows, data):
    fitted = boosting.fit_boosted(rows, ["y", "z"], [CONFIG])
    p = {(r["outcome"], r["id"]): r["p1"] for r in fitted.predict(rows, fold=None).collect()}
    for o, name in enumerate(["y", "z"]):
        x, y, ids = arrays(data, 4 + o)
        odds, gains = plain(x, y, CONFIG)
        assert np.allclose([p[name, i] for i in ids], 1 / (1 + np.exp(-odds)), atol=1e-5)
        root = next(s for s in fitted.splits if s.run == o and s.node == 0)
        assert root.gain == pytest.approx(gains[0], abs=1e-4)
    assert fitted.importance().argmax() in (0, 1) and fitted.importance().sum() > 8


def test_folds_left_out_and_parameter_sets(rows, data):
    configs = [CONFIG, {**CONFIG, "trees": 2, "depth": 2, "penalty": 5.0}]
    fitted = boosting.fit_boosted(rows, ["y"], configs, v=3)
    got = fitted.predict(rows)
    assert got.count() == 600
    x, y, ids = arrays(data, 4)
    for k, config in enumerate(configs):
        alone = boosting.fit_boosted(rows.filter("fold <> 1"), ["y"], [config])
        here = {r["id"]: r["p1"] for r in got.filter(f"fold = 1 and config = 'Model0{k + 1}'").collect()}
        there = {r["id"]: r["p1"] for r in alone.transform(rows.filter("fold = 1")).collect()}
        assert here == pytest.approx(there, abs=1e-9)


def test_weights_equal_copies(rows):
    copies = rows.filter("w > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), "w"))).drop("_c")
    a = boosting.fit_boosted(rows.filter("w > 0"), ["y"], [CONFIG], weight="w").trees
    b = boosting.fit_boosted(copies, ["y"], [CONFIG]).trees
    # Copies are rounded one by one.
    assert a.value == pytest.approx(b.value, abs=1e-4)


def test_every_way_of_adding_gives_the_same_trees(rows, monkeypatch):
    config = [{**CONFIG, "mtry": 0.6}]
    direct = boosting.fit_boosted(rows, ["y", "z"], config, tasks=1).trees
    monkeypatch.setattr(boosting, "DIRECT_BYTES", 40_000)  # the first levels on the driver, the rest by table
    monkeypatch.setattr(boosting, "SCAN_BYTES", 1)
    monkeypatch.setattr(boosting, "TREES_BETWEEN", 1)
    other = boosting.fit_boosted(rows, ["y", "z"], config, tasks=5).trees
    assert (direct.feature == other.feature).all() and (direct.bin == other.bin).all() and np.array_equal(direct.value, other.value)


def test_odd_rows_and_saving(spark, rows):
    table = [(1, 0, 1, [0.0, None], 0, 0), (2, 0, 1, None, 1, 1), (3, 0, None, [1.0, 2.0], 1, 0), (4, 0, 1, [float("nan"), 1.0], 1, 1)]
    odd = spark.createDataFrame(table, SCHEMA)
    fitted = boosting.fit_boosted(odd, ["y"], [{"min_n": 0.0}], weight="w")
    out = {r["id"]: r["p1"] for r in fitted.transform(odd).collect()}
    assert out[2] is None and out[4] > 0.5 > out[1]
    path = new_table_path(spark, "boosted")
    fitted.save(path)
    again = {r["id"]: r["p1"] for r in boosting.Boosted.load(path).transform(odd).collect()}
    assert again == out
    with pytest.raises(ValueError):
        boosting.fit_boosted(odd.limit(0), ["y"], [{}])


def test_bins_hold_equal_shares(spark):
    df = spark.createDataFrame([([float(i % 100), 1.0],) for i in range(1000)], "_x array<double>")
    cuts = boosting.feature_cuts(df, 2, 10)
    assert cuts[0].tolist() == [9.0, 19.0, 29.0, 39.0, 49.0, 59.0, 69.0, 79.0, 89.0] and cuts[1].tolist() == []


def test_only_cells_outside_the_common_bin_are_counted(monkeypatch):
    rng = np.random.default_rng(8)
    n, width, bins, runs = 500, 6, 8, [boosting.Run(0, 0, f, 1, 2, 0.3, 1.0, 0.0, 0.0, 1.0) for f in (-1, 0)]
    codes = np.where(rng.random((n, width)) < 0.9, 3, rng.integers(0, bins, (n, width))).astype(np.uint8)
    y, fold, weight = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, n), rng.integers(0, 3, n).astype(float)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(fold), pa.array([[v] for v in y]), pa.array(weight), pa.array([c.tobytes() for c in codes]), pa.array([b""] * n, pa.binary())],
        names=["_f", "_y", "_w", "_c", "_m"],
    )
    now = boosting.Trees(np.array([[[1, -1, -1], [0, -1, -1]]]), np.array([[[3, 0, 0], [2, 0, 0]]]), np.zeros((1, 2, 3)))
    none = boosting.Trees(np.zeros((0, 2, 3), int), np.zeros((0, 2, 3), int), np.zeros((0, 2, 3)))
    lengths, count = [], np.bincount
    monkeypatch.setattr(boosting.np, "bincount", lambda x, *a, **k: lengths.append(len(x)) or count(x, *a, **k))
    (out,) = boosting._histograms(runs, [0, 1], [(0, 1), (0, 2), (1, 2)], none, now, width, bins, 2)(iter([batch]))
    monkeypatch.undo()
    # Of all cells only those outside the common bin are summed up; the first call counts the bins themselves.
    assert max(lengths[1:]) < n * width / 3
    for run, node, data in zip(*(out.column(i).to_pylist() for i in range(3))):
        f, cut = (1, 3) if run == 0 else (0, 2)
        rows = (codes[:, f] > cut if node == 2 else codes[:, f] <= cut) & (fold != (-1, 0)[run])
        want = np.zeros((2, width, bins))
        for i, v in enumerate((np.rint(weight * (0.5 - y) * boosting.UNIT), np.rint(weight * 0.25 * boosting.UNIT))):
            for j in range(width):
                np.add.at(want[i, j], codes[rows, j], v[rows])
        assert (np.frombuffer(data, np.int64).reshape(want.shape) == want).all()
