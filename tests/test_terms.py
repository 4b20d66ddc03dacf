"""TF-IDF by a dictionary table."""

from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textlabel.operators import terms
from textlabel.operators.features import TfidfRecipe

ROWS = [(i, " ".join(f"w{j}" for j in range(i % 7) for _ in range(j % 3 + 1)) + " The end") for i in range(40)] + [(90, None), (91, ""), (92, "the of")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string").repartition(3)


def test_counts_and_numbers(spark, docs):
    recipe = terms.WideTfidf(min_times=1)
    counts = recipe.counts(docs)
    want = {(i, w): k for i, t in ROWS for w, k in Counter((t or "").lower().split()).items()}
    assert {(r.id, r.token): r.k for r in counts.collect()} == want
    many = spark.range(30_000).select(F.concat(F.lit("t"), "id").alias("token"))
    idx = [r.idx for r in terms.numbered(many).collect()]
    assert sorted(idx) == list(range(30_000))


def test_equals_the_literal_form(spark, docs):
    small = TfidfRecipe(min_times=3, max_tokens=100).fit(docs)
    recipe = terms.WideTfidf(min_times=3)
    counts = recipe.counts(docs)
    wide = recipe.fit(counts, docs.count())
    assert wide.size == len(small.terms)
    for limit in (None, 0):  # broadcast and salted
        got = {(r.id, r.token): r.tfidf for r in wide.cells(counts, "id", max_bytes=limit).select("id", F.inline("features")).collect()}
        want = {(r.id, r.token): r.tfidf for r in small.long(docs, "id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    vectors = wide.vectors(docs, counts, "id").select("id", vector_to_array("features").alias("v")).collect()
    assert len(vectors) == len(ROWS) and all(len(r.v) == wide.size for r in vectors)
    name = {r.token: r.idx for r in wide.table.collect()}
    assert {(r.id, t) for r in vectors for t, i in name.items() if r.v[i] > 0} == want.keys()


def test_folds_equal_separate_fits(spark, docs):
    folds = docs.withColumn("fold", F.pmod("id", F.lit(4)))
    recipe = terms.WideTfidf(min_times=2)
    counts = recipe.counts(folds, "fold")
    sizes = [folds.filter(F.col("fold") == f).count() for f in range(4)]
    for f, fitted in enumerate(recipe.fit_folds(counts, "fold", sizes)):
        alone = recipe.fit(counts.filter(F.col("fold") != f), sum(sizes) - sizes[f])
        assert sorted(map(tuple, fitted.table.collect())) == sorted(map(tuple, alone.table.collect()))


def test_empty_table(spark):
    recipe = terms.WideTfidf()
    counts = recipe.counts(spark.createDataFrame([], "id long, text string"))
    fitted = recipe.fit(counts, 0)
    assert fitted.size == 0 and fitted.cells(counts, "id").count() == 0


def test_frequent_terms_are_broadcast_and_rare_ones_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(terms, "CELLS_PER_TASK", 60)
    texts = [(i, f"the often often half{i % 2} rare{i} rare{i // 2}") for i in range(60)] + [(60, None), (61, "the")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    recipe = terms.WideTfidf(min_times=1)
    counts = recipe.counts(docs)
    wide = recipe.fit(counts, docs.count())
    # 64 bytes a term and its letters: once the most frequent term alone, once the three that are in 16 texts or more.
    assert [wide._least_broadcast(n) for n in (0, 68, 69, 300, 10_000)] == [None, None, 32, 16, 1]
    want = sorted(map(str, wide.cells(counts, "id").collect()))
    assert len(want) == 60 and "the" not in "".join(want)
    for limit in (0, 69, 300):
        cells = wide.cells(counts, "id", max_bytes=limit)
        assert sorted(map(str, cells.collect())) == want
        # No copies of the dictionary; as many tasks as the cells ask for.
        assert "_copy" not in cells._jdf.queryExecution().toString() and cells.rdd.getNumPartitions() == -(-counts.count() // 60)
