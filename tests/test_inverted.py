import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabel.operators import inverted


def exact(points, k):
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.argsort(row, kind="stable")[:k]] for i, row in enumerate(d)}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    out = rng.normal(size=(24, 64))[rng.integers(0, 24, 500)] + 0.6 * rng.normal(size=(500, 64))
    out[400:480] = out[400]  # a hot group of copies
    return out


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)] + [(None, points[0].tolist(), "x"), (900, None, "x")]
    return spark.createDataFrame(rows, "id long, vec array<double>, list string").repartition(3)


@pytest.fixture(scope="module")
def index(table):
    return inverted.InvertedLists.fit(table, k=5, target=0.95)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.train_id)
    return out


def test_recall_is_measured_and_kept(table, index, points):
    assert index.recall >= 0.95 and index.probes < len(index.centroids)
    want, got = exact(points, 5), found(index.search(table, table, 5, exclude_self=True))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want)) >= 0.9


def test_all_lists_give_the_exact_neighbours(table, index, points):
    blocks = index.search(table, table, 5, exclude_self=True, probes=len(index.centroids), block_rows=16)
    want, got = exact(points, 5), found(blocks)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i] == want[i] for i in range(400, 480))  # ties go by id


def test_codes_are_near_the_vectors(table, index, points):
    for r in index.file(table.dropna().select("id", "vec")).collect():
        back = index.centroids[r.list] + index.low + np.frombuffer(r.code, np.uint8) * index.step
        assert np.abs(back - points[r.train_id]).max() <= index.step.max() / 2 + 1e-9


def test_nothing_to_search(table, index):
    assert index.search(table.filter("false"), table, 3).count() == 0
    with pytest.raises(ValueError):
        inverted.InvertedLists.fit(table.filter(F.lit(False)))


def test_a_query_is_copied_by_shelf_and_not_by_list(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "id long, vec array<double>").repartition(3)
    index = inverted.InvertedLists.fit(df, k=3, lists=20)
    stored = {}
    settle = inverted.settle
    monkeypatch.setattr(inverted, "settle", lambda d, label: stored.setdefault(label, settle(d, label)))
    got = {r["query_id"]: r["train_id"] for r in index.search(df, df, 1, probes=20).collect()}
    assert got == {i: i for i in range(300)} and stored["routed-queries"].count() == 300
    monkeypatch.setattr(inverted, "settle", settle)
    some = {r["query_id"]: r["train_id"] for r in index.search(df, df, 1, probes=20, block_rows=5).collect()}
    assert some == got
