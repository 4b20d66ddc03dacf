"""Networks in the joint solver: gradients by differences, weights as copies, penalties, folds left out, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlabel.plans import models, network, queries

SCHEMA = "id long, fold long, w int, features array<double>, y int, z int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(600) < 0.05)).astype(int)  # no line parts these
    z = (x[:, 2] > 0.5).astype(int)
    return [(i, i % 3, int(rng.integers(0, 4)), x[i].tolist(), int(y[i]), None if i % 11 == 0 else int(z[i])) for i in range(600)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((30, 1)), rng.normal(size=(30, 3))])
    y, w = (rng.random((30, 2)) < 0.4).astype(float), rng.random((30, 2)) * 3
    theta = rng.normal(size=(2, 4 * 3 + 3 + 1))
    _, grad = network.loss_and_gradient(theta, x, y, w, 3)
    for j in range(theta.shape[1]):
        step = np.zeros_like(theta)
        step[:, j] = 1e-6
        up, down = (network.loss_and_gradient(theta + s, x, y, w, 3)[0] for s in (step, -step))
        assert np.allclose((up - down) / 2e-6, grad[:, j], atol=1e-6)


def test_learns_what_no_line_can(rows):
    fitted = network.fit_networks(rows, ["y", "z"], [{"hidden_units": 6, "penalty": 0.01, "epochs": 80}], v=3)
    pred = fitted.predict(rows)
    hit = {r["outcome"]: r["hit"] for r in pred.filter("truth is not null").groupBy("outcome").agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("hit")).collect()}
    assert pred.count() == 1200 and hit["y"] > 0.85 and hit["z"] > 0.95
    assert pred.filter("outcome = 'z' and truth is null").count() == 55


def test_weights_equal_copies(rows):
    config = [{"hidden_units": 3, "penalty": 0.1, "epochs": 25}]
    weighted = network.fit_networks(rows, ["y"], config, weight="w")
    copies = rows.filter("w > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), "w")))
    repeated = network.fit_networks(copies, ["y"], config)
    assert weighted.value == pytest.approx(repeated.value, rel=1e-5)


def test_penalty_shrinks_and_runs_are_independent(rows):
    configs = [{"hidden_units": u, "penalty": p, "epochs": 15} for u, p in ((2, 0.01), (5, 0.01), (5, 10.0))]
    joint = network.fit_networks(rows, ["y", "z"], configs, v=3)
    norms = [np.square(joint.theta[i]).sum() for i, r in enumerate(joint.runs) if r.outcome == 1 and r.fold == -1]
    assert norms[2] < norms[1]
    left_out = next(i for i, r in enumerate(joint.runs) if (r.outcome, r.config, r.fold) == (1, 1, 2))
    alone = network.fit_networks(rows.filter("fold <> 2"), ["z"], [configs[1]])
    assert joint.value[left_out] == pytest.approx(alone.value[0], rel=1e-4)


def test_sums_by_groups_equal_direct_sums(rows, monkeypatch):
    config = [{"hidden_units": 2, "penalty": 0.1, "epochs": 6}]
    direct = network.fit_networks(rows, ["y"], config, v=3)
    monkeypatch.setattr(network, "DIRECT_BYTES", 0)
    assert network.fit_networks(rows, ["y"], config, v=3).theta == pytest.approx(direct.theta, abs=1e-6)


def test_odd_rows(spark):
    table = [(1, 0, 1, [0.0, None], 0, 0), (2, 0, 1, None, 1, 1), (3, 0, None, [1.0, 2.0], 1, 0), (4, 0, 1, [float("nan"), 1.0], 1, 1)]
    odd = spark.createDataFrame(table, SCHEMA)
    fitted = network.fit_networks(odd, ["y"], [{"hidden_units": 1, "penalty": 0.1}], weight="w")
    out = {r["id"]: r["p1"] for r in fitted.transform(odd).collect()}
    assert out[2] is None and all(0 < out[i] < 1 for i in (1, 3, 4))
    with pytest.raises(ValueError):
        network.fit_networks(odd.limit(0), ["y"], [{}])


def test_shares_of_a_scan_equal_one_run_at_a_time():
    rng = np.random.default_rng(4)
    x, y, fold = rng.normal(size=(300, 5)), (rng.random((300, 2)) < 0.4).astype(float), rng.integers(0, 3, 300)
    y[::9, 1] = np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(fold), pa.array(y.tolist()), pa.array(np.full(300, 2.0)), pa.array(x.tolist())], names=["f", "y", "w", "x"])
    runs = [network.Run(o, k, k + 1, 0.1, 5, f) for o in (0, 1) for k in (3, 0, 2) for f in (-1, 0, 2)]
    theta = np.stack([np.where(network._used(6, 4, r.units), rng.normal(size=6 * 4 + 5), 0.0) for r in runs])
    assert all(len(s[0]) * s[1] <= network.COLUMNS for s in network._shares(runs * 99, 6, 4))  # whatever the number of runs
    (sums,) = network._scan(theta, runs, 4)(network._pack(iter([batch])))
    got = dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist()))
    for i, r in enumerate(runs):
        known = ~np.isnan(y[:, r.outcome]) & (fold != r.fold)
        loss, grad = network.loss_and_gradient(theta[[i]], np.hstack([np.ones((300, 1)), x]), np.nan_to_num(y[:, [r.outcome]]), 2.0 * known[:, None], 4)
        assert np.frombuffer(got[i]) == pytest.approx(np.concatenate([loss, grad[0][network._used(6, 4, r.units)]]))


def test_the_query_takes_the_whole_space(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(60) < 0.2)).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), i % 10) for i in range(60)], "id long, features array<double>, free int, fold long")
    kept, fit = [], network.fit_networks
    monkeypatch.setattr(queries, "FLAGS", ["free"])
    monkeypatch.setattr(queries, "path_rows", lambda *_: rows)
    monkeypatch.setattr(network, "fit_networks", lambda *a, **b: kept.append(fit(*a, **b)) or kept[0])
    assert queries.QUERIES["network_tuning"](spark, "").select("config").distinct().count() == 10
    epochs = sorted(c["epochs"] for c in kept[0].configs)
    assert all(10 + 99.1 * i <= e <= 10 + 99.1 * (i + 1) for i, e in enumerate(epochs))  # one from each tenth of 10 to 1,000
    assert kept[0].configs == models.random_grid(models.MODELS["mlp"].space, 10)
    assert kept[0].steps.max() > 60 and all(s <= r.epochs for s, r in zip(kept[0].steps, kept[0].runs))


def test_followed_runs_equal_steps_over_all_rows(rows, monkeypatch):
    configs = [{"hidden_units": u, "penalty": 0.1, "epochs": e} for u, e in ((2, 9), (5, 4), (2, 6))]
    scans, scan = [], network.summed
    monkeypatch.setattr(network, "summed", lambda *a: scans.append(1) or scan(*a))
    held = network.fit_networks(rows, ["y", "z"], configs, v=3, weight="w")
    assert not scans
    monkeypatch.setattr(network, "HELD_BYTES", 0)
    monkeypatch.setattr(network, "DIRECT_BYTES", 0)
    steps = network.fit_networks(rows, ["y", "z"], configs, v=3, weight="w")
    assert len(scans) >= 9 and held.runs == steps.runs and (held.steps == steps.steps).all()
    assert held.theta == pytest.approx(steps.theta, abs=1e-6) and held.value == pytest.approx(steps.value, rel=1e-6)


def test_shares_hold_every_run_once_and_keep_tasks_busy():
    runs = [network.Run(o, k, k + 1, 0.1, 10 * k + 10, f) for o in range(9) for k in range(10) for f in range(-1, 10)]
    for tasks in (1, 8, 300):
        shares = network._spread(runs, tasks)
        assert sorted(i for share in shares for i in share) == list(range(990)) and len(shares) >= tasks
        assert all(len({runs[i].units for i in share}) == 1 and len(share) * runs[share[0]].units <= network.COLUMNS for share in shares)


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_packed_blocks_come_back(share):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 7)) * (rng.random((300, 7)) < share), (rng.random((300, 2)) < 0.4).astype(float)
    x[5], y[::9, 1] = 0, np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300) % 4), pa.array(y.tolist()), pa.array(rng.random(300)), pa.array(x.tolist())], names=["f", "y", "w", "x"])
    for packed, plain in zip(network._packed(network._pack(iter([batch])), 8), network.blocks(iter([batch])), strict=True):
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(packed, plain, strict=True))
