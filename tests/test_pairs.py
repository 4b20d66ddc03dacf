"""Pair counts against the product of the matrix with itself, with and without dense blocks."""

import numpy as np
import pyarrow as pa
import pytest

from textlabel.operators import pairs


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(6)
    share = np.minimum(0.9, 8 / np.arange(1, 5001))  # a few columns in most rows, most in very few
    x = rng.random((250, 5000)) < share
    x[7, :1500] = True  # one very long row
    x[8] = False
    return x


@pytest.mark.parametrize("frequent, held", [(64, 1 << 22), (0, 50_000), (5000, 1 << 22), (512, 1)])
def test_equals_the_matrix_product(spark, matrix, monkeypatch, frequent, held):
    monkeypatch.setattr(pairs, "PAIRS_HELD", held)
    x = matrix[:40, :300] if held == 1 else matrix
    df = spark.createDataFrame([(np.flatnonzero(r).tolist(),) for r in x], "items array<int>").repartition(3)
    got = pairs.pair_counts(df, "items", frequent).toPandas()
    product = np.triu(x.T.astype(np.float32) @ x.astype(np.float32)).astype(int)
    assert len(got) == np.count_nonzero(product)
    assert (product[got["a"], got["b"]] == got["n"]).all()


def test_odd_rows(spark, rows):
    df = spark.createDataFrame([([2**31 - 1, 5, 5, None],), (None,), ([],), ([5],), ([0, 5],)], "items array<int>")
    expected = [(0, 0, 1), (0, 5, 1), (5, 5, 3), (5, 2**31 - 1, 1), (2**31 - 1, 2**31 - 1, 1)]
    for frequent in (0, 1, 10):
        assert sorted(rows(pairs.pair_counts(df, "items", frequent))) == expected
    assert rows(pairs.pair_counts(df, "items", min_n=2)) == [(5, 5, 3)]
    assert pairs.pair_counts(df.limit(0), "items").count() == 0


def test_short_rows_are_held_as_few_arrays(monkeypatch):
    seen = []
    counted = pairs._counted
    monkeypatch.setattr(pairs, "_counted", lambda held: seen.append(len(held)) or counted(held))
    table = pa.RecordBatch.from_arrays([pa.array([[i, i + 1, i + 2] for i in range(20_000)], pa.list_(pa.int32()))], names=["i"])
    out = list(pairs.counter([])(iter([table])))
    total = pa.Table.from_batches(out).to_pandas().groupby(["a", "b"])["n"].sum()
    assert total.sum() == 120_000 and total[(5, 7)] == 1 and total[(5, 6)] == 2 and total[(5, 5)] == 3
    assert max(seen) <= 20_000 // pairs.ARRAYS_HELD + 1
