"""Kernel densities against direct sums, and the classifier made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabel.operators import densities


def rows_of(spark, x, y):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r], None if t is None else int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, features array<double>, truth int").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    sparse = np.where(rng.random(300) < 0.8, 0.0, rng.random(300) + y)
    return np.stack([rng.normal(size=300) + 2 * y, sparse, np.full(300, 4.0), np.zeros(300)], 1), y


def bandwidth(v):
    sd, iqr = v.std(ddof=1), np.subtract(*np.percentile(v, [75, 25]))
    low = min(sd, iqr / 1.34) or sd or abs(v[0]) or 1
    return 0.9 * low * len(v) ** -0.2


def test_densities_equal_direct_sums(spark, data):
    x, y = data
    for r in densities.fit_densities(rows_of(spark, x, y)).collect():
        v = x[y == r.truth, r.dim]
        assert r.bw == pytest.approx(bandwidth(v), rel=1e-9) and r.n == len(v)
        grid = r.low + r.step * np.arange(512)
        direct = np.exp(-0.5 * ((grid[:, None] - v) / r.bw) ** 2).sum(1) / (len(v) * r.bw * np.sqrt(2 * np.pi))
        assert np.abs(np.array(r.density) - direct).max() < 2e-3 * direct.max()


def test_classifier(spark, data):
    x, y = data
    df = rows_of(spark, x, y)
    got = densities.KernelBayes.fit(df).transform(df).collect()
    assert np.mean([r.pred == r.truth for r in got]) > 0.85
    for r in got[::50]:
        odds = np.log((y == 1).sum() / (y == 0).sum())
        for c, sign in ((0, -1), (1, 1)):
            for d in range(4):
                v = x[y == c, d]
                h = bandwidth(v)
                odds += sign * np.log(np.exp(-0.5 * ((r.features[d] - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi)))
        assert abs(np.log(r.p1 / r.p0) - odds) < 0.05


def test_missing_values_and_classes(spark, data):
    x, y = data
    x = x.copy()
    x[0, 0] = np.nan
    df = rows_of(spark, x, [None if i == 1 else t for i, t in enumerate(y)])
    assert sum(r.n for r in densities.fit_densities(df).filter("dim = 0").collect()) == 298
    assert densities.KernelBayes.fit(df).transform(df).filter("p1 is null").count() == 0
    with pytest.raises(ValueError):
        densities.KernelBayes.fit(df.filter("truth = 1"))
    assert densities.fit_densities(df.filter(F.lit(False))).count() == 0
