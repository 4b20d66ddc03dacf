"""The joint lasso path against one-by-one fits, the optimality conditions and Spark's own regression."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlabel.plans import path, queries

PENALTIES = [0.2, 0.03, 0.003, 0.0003]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) * np.array([1, 5, 0.1, 1, 1, 2, 1, 0]) + 0.3
    x[:, 3] = x[:, 0] * 0.9 + x[:, 3] * 0.2
    y = (x @ np.array([1.0, -0.2, 3, 0, 0.4, 0, 0, 0]) + rng.logistic(size=400) > 0.5).astype(float)
    z = (rng.random(400) < 0.05).astype(float)
    z[::7] = np.nan
    return x, np.stack([y, z], 1), np.arange(400) % 5


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    table = [(i, int(fold[i]), x[i].tolist(), *[None if np.isnan(t) else int(t) for t in y[i]]) for i in range(len(x))]
    return spark.createDataFrame(table, "id long, fold long, features array<double>, y int, z int").repartition(3)


@pytest.fixture(scope="module")
def fitted(rows):
    return path.fit_path(rows, ["y", "z"], PENALTIES, v=5, tol=1e-9)


def test_optimality_of_every_run(data, fitted):
    x, y, fold = data
    assert fitted.coef.shape == (2, 4, 6, 9) and fitted.converged.all()
    for o in range(2):
        for k, penalty in enumerate(PENALTIES):
            for run in range(6):
                at = (fold != run) & ~np.isnan(y[:, o])
                xs, ys = x[at], y[at, o]
                b = fitted.coef[o, k, run]
                p = 1 / (1 + np.exp(-(b[0] + xs @ b[1:])))
                grad, sd = xs.T @ (p - ys) / len(ys), xs.std(0, ddof=1)
                assert abs((p - ys).mean()) < 1e-8 and b[8] == 0
                for j in range(7):
                    if b[j + 1]:
                        assert abs(grad[j] + np.sign(b[j + 1]) * penalty * sd[j]) < 1e-7
                    else:
                        assert abs(grad[j]) <= penalty * sd[j] + 1e-7


def test_equals_separate_fits(rows, fitted):
    for run in (0, 3):
        alone = path.fit_path(rows.filter(F.col("fold") != run), ["y"], [0.003], v=0, tol=1e-9)
        assert np.abs(alone.coef[0, 0, 0] - fitted.coef[0, 2, run]).max() < 1e-6


def test_equals_the_package(rows, fitted):
    train = rows.withColumn("features", array_to_vector("features")).withColumn("y", F.col("y").cast("double"))
    one = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=0.03, tol=1e-12, maxIter=2000).fit(train)
    assert np.abs(one.coefficients.toArray() - fitted.coef[0, 1, 5, 1:]).max() < 1e-4


def test_predictions_are_out_of_fold(data, rows, fitted):
    x, y, fold = data
    got = fitted.predict(rows).collect()
    assert len(got) == 400 * 8
    for r in got[::37]:
        b = fitted.coef[["y", "z"].index(r.outcome), int(r.config[5:]) - 1, fold[r.id]]
        assert r.p1 == pytest.approx(1 / (1 + np.exp(-(b[0] + x[r.id] @ b[1:])))) and r.fold == fold[r.id]
        t = y[r.id, ["y", "z"].index(r.outcome)]
        assert r.truth == (None if np.isnan(t) else t)
    assert fitted.predict(rows, fold=None).filter("fold = 5").count() == 3200


def test_separable_and_empty(spark, rows):
    split = rows.withColumn("y", (F.get("features", F.lit(0)) > 0).cast("int"))
    fitted = path.fit_path(split, ["y"], [0.1, 1e-3], v=2)
    assert fitted.converged.all() and np.isfinite(fitted.coef).all()
    with pytest.raises(ValueError):
        path.fit_path(rows.limit(0), ["y"], [0.1])


def test_the_query_follows_every_run_to_its_end(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)  # a line parts these: small penalties take many steps
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), i % 10) for i in range(100)], "id long, features array<double>, free int, fold long")
    kept, fit = [], path.fit_path
    monkeypatch.setattr(queries, "FLAGS", ["free"])
    monkeypatch.setattr(queries, "path_rows", lambda *_: rows)
    monkeypatch.setattr(path, "fit_path", lambda *a, **b: kept.append(fit(*a, **b)) or kept[0])
    assert queries.QUERIES["lasso_path"](spark, "").select("config").distinct().count() == 30
    assert kept[0].converged.all() and kept[0].steps > 20
    assert not fit(rows, ["free"], v=10, max_steps=20).converged.all()


def test_one_class_ends(rows):
    """Its intercept would grow for ever, by one a step."""
    fitted = path.fit_path(rows.withColumn("y", F.lit(0)).withColumn("z", F.lit(1)), ["y", "z"], [0.1, 1e-3], v=2)
    assert fitted.converged.all() and np.isfinite(fitted.coef).all()
    assert (fitted.coef[0, :, :, 0] < -20).all() and (fitted.coef[1, :, :, 0] > 20).all()


def test_scan_equals_the_plain_sums(monkeypatch):
    """Rows of several folds, partly and wholly unknown outcomes, pieces smaller than the batch, shared and own blocks."""
    monkeypatch.setattr(path, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(path, "GRAM_ROWS", 16)
    rng = np.random.default_rng(9)
    n, v = 70, 3
    x, y, fold = rng.normal(size=(n, 4)), (rng.random((n, 3)) < 0.4).astype(float), np.sort(np.arange(n) % v)
    y[::4, 1], y[:40, 2] = np.nan, np.nan
    pairs, ones = [(0, 0), (0, 1), (1, 1), (2, 0)], np.hstack([np.ones((n, 1)), x])
    coef = rng.normal(size=(4, v + 1, 5)) * 3
    coef[3, 1] = 400  # far from the middle: no overflow
    batch = pa.RecordBatch.from_arrays([pa.array(fold), pa.array(y.tolist()), pa.array(x.tolist())], names=["_f", "_y", "_x"])
    upper = np.triu_indices(5)
    for own in (None, np.array([[0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1], [0, 0, 1, 0]], bool)):
        got = {}
        for out in path._scan(coef, pairs, v, own)(iter([batch, batch.slice(0, 0)])):
            got.update({(k, b): np.frombuffer(d) for k, b, d in zip(*(c.to_pylist() for c in out.columns))})
        blocks = 1 + v if own is None else None
        assert len(got) == (4 * blocks if blocks else 4 + own.sum())
        for k, (o, _) in enumerate(pairs):
            eta = ones @ coef[k].T
            inside = ((fold[:, None] != np.arange(v + 1)) | (np.arange(v + 1) == v)) & ~np.isnan(y[:, [o]])
            t = np.nan_to_num(y[:, [o]])
            p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            loss, grad = ((np.logaddexp(0, eta) - t * eta) * inside).sum(0), ((p - t) * inside).T @ ones
            assert np.allclose(got[k, -1], np.concatenate([grad.ravel(), loss]), rtol=1e-10, atol=1e-10)
            weight = p * (1 - p) * inside
            for b in range(v) if own is None else np.flatnonzero(own[k]):
                w = weight[:, b] if own is not None else weight.sum(1) / np.maximum(inside.sum(1), 1) * (fold == b)
                assert np.allclose(got[k, b], ((ones * w[:, None]).T @ ones)[upper], rtol=1e-10, atol=1e-10)
    assert path._products(ones).shape == (15, n)
