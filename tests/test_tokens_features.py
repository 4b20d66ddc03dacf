import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textlabel.functions.text import tokenize
from textlabel.operators import features, tokens

DOCS = [
    ("1", "Can't stop: the 4.5 mg dose, the DOSE."),
    ("2", "dose"),
    ("3", ""),
    ("4", None),
    ("5", "été_x père 4-ANPP dose dose"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, text string")


def test_tokens_with_positions(docs, rows):
    got = [r["word"] for r in tokens.tokens(docs).filter("id = '1'").orderBy("pos").collect()]
    assert got == ["can't", "stop", "the", "4.5", "mg", "dose", "the", "dose"]
    assert [r["word"] for r in tokens.tokens(docs).filter("id = '5'").orderBy("pos").collect()] == [
        "été_x", "père", "4", "anpp", "dose", "dose",
    ]


def test_tokenize_options(docs):
    one = docs.filter("id = '1'")
    kept = one.select(tokenize("text", lower=False, strip_punct=False).alias("t")).first()["t"]
    assert kept == ["Can't", "stop", ":", "the", "4.5", "mg", "dose", ",", "the", "DOSE", "."]


def test_short_texts_give_a_null_bigram(docs):
    grams = tokens.ngrams(docs)
    assert grams.filter("id = '2'").collect()[0]["bigram"] is None
    assert grams.filter("id = '3'").count() == 1
    assert tokens.ngrams(docs, keep_null=False).filter("id = '2'").count() == 0
    assert [r["bigram"] for r in tokens.ngrams(docs, n=3).filter("id = '5'").collect()] == [
        "été_x père 4", "père 4 anpp", "4 anpp dose", "anpp dose dose",
    ]


def test_bigrams_are_counted_in_bounded_pieces(spark, monkeypatch):
    texts = [None, "", "one"] + ["a a a b"] * 30 + [f"x{i} y{i} z" for i in range(50)]
    want = Counter(pair for t in texts for pair in (list(map(" ".join, zip((t or "").split(), (t or "").split()[1:]))) or [None]))
    monkeypatch.setattr(tokens, "BIGRAMS_AT_ONCE", 7)
    monkeypatch.setattr(tokens, "TEXT_PER_TASK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        counts = tokens.bigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
        assert {r["bigram"]: r["n"] for r in counts.collect()} == want and counts.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # The tasks that sum up follow the size of the texts, not a fixed number.
    assert counts.rdd.getNumPartitions() == -(-sum(len(t or "") for t in texts) // 50) > 8
    assert tokens.bigram_counts(spark.createDataFrame([], "text string")).count() == 0


def test_bigram_pairs_and_graph(docs, rows):
    pairs = tokens.bigram_pairs(docs, stop=["the"])
    got = {(r["word1"], r["word2"]): r["n"] for r in pairs.collect()}
    assert got == {
        ("can't", "stop"): 1, ("4.5", "mg"): 1, ("mg", "dose"): 1, ("été_x", "père"): 1, ("père", "4"): 1,
        ("4", "anpp"): 1, ("anpp", "dose"): 1, ("dose", "dose"): 1,
    }
    vertices, edges = tokens.bigram_graph(pairs.withColumn("n", F.lit(5)).limit(8), 4)
    assert edges.count() == 8 and vertices.count() == 9
    assert tokens.bigram_graph(pairs, 1)[1].count() == 0


def test_stop_words_split_the_input(docs):
    rows = tokens.tokens(docs)
    kept = tokens.remove_stopwords(rows, ["the", "dose"])
    stop = docs.sparkSession.createDataFrame([("the",), ("dose",), ("the",)], "value string")
    assert kept.count() == tokens.remove_stopwords(rows, stop).count() == rows.count() - rows.filter("word in ('the','dose')").count()


def test_common_words_equal_filtering_tokens(docs, rows):
    many = docs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4))))
    got = {r["word"]: r["n"] for r in tokens.common_words(many, min_n=7).collect()}
    assert got == {"dose": 20}
    assert [r["word"] for r in tokens.top_words(tokens.word_counts(many), 2).collect()] == ["dose", "the"]


def test_token_stats(docs, rows):
    got = {r["token"]: (r["n"], r["df"]) for r in features.token_stats(docs, tokenize("text")).collect()}
    assert got["dose"] == (5, 3) and got["the"] == (2, 1) and len(got) == 10


def test_vocabulary_cut_is_before_stop_words(docs):
    recipe = features.TfidfRecipe(min_times=1, max_tokens=2, stop=["the"])
    assert [r["token"] for r in recipe.vocabulary(docs).collect()] == ["dose"]


def test_tfidf_by_hand(docs):
    model = features.TfidfRecipe(min_times=2, stop=()).fit(docs)
    assert model.terms == ["dose", "the"]
    got = {(r["id"], r["token"]): (r["tf"], r["tfidf"]) for r in model.long(docs, "id").collect()}
    assert set(got) == {("1", "dose"), ("1", "the"), ("2", "dose"), ("5", "dose")}
    tf, value = got[("1", "the")]
    assert tf == 0.5 and math.isclose(value, 0.5 * math.log(1 + 5 / 1))
    assert math.isclose(got[("2", "dose")][1], math.log(1 + 5 / 3))
    zero = model.transform(docs).filter("id in ('3','4')").select(vector_to_array("features").alias("v")).collect()
    assert [r["v"] for r in zero] == [[0.0, 0.0], [0.0, 0.0]]


def test_tfidf_save_and_load(docs, tmp_path, rows):
    model = features.TfidfRecipe(min_times=2, stop=()).fit(docs)
    model.save(str(tmp_path / "m"))
    back = features.TfidfModel.load(str(tmp_path / "m"))
    assert back.terms == model.terms
    assert rows(back.long(docs, "id")) == rows(model.long(docs, "id"))


@pytest.fixture(scope="module")
def vectors(spark):
    data = [("dose", [1.0, 2.0, 0.5]), ("the", [0.25, 0.0, -1.0]), ("anpp", [3.0, 3.0, 3.0]), ("unused", [9.0, 9.0, 9.0])]
    return spark.createDataFrame(data, "token string, vec array<double>")


def brute_embedding(lower=True):
    import regex

    table = {"dose": [1.0, 2.0, 0.5], "the": [0.25, 0.0, -1.0], "anpp": [3.0, 3.0, 3.0]}
    out = {}
    for key, text in DOCS:
        words = regex.findall(r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*", (text or "").lower() if lower else text or "")
        out[key] = np.sum([np.zeros(3)] + [c * np.array(table[w]) for w, c in Counter(words).items() if w in table], axis=0)
    return out


@pytest.mark.parametrize("max_bytes", [0, 10**8])
def test_embedding_join_form(docs, vectors, max_bytes):
    got = features.doc_embedding(docs, vectors, 3, "id", tokenize("text"), max_bytes=max_bytes).collect()
    want = brute_embedding()
    assert len(got) == len(DOCS)
    for r in got:
        assert np.allclose(r["vec"], want[r["id"]])


def test_embedding_recipe_and_reload(docs, vectors, tmp_path):
    model = features.EmbeddingRecipe(vectors, 3, lower=True, min_times=1, stop=()).fit(docs)
    model.save(str(tmp_path / "e"))
    want = brute_embedding()
    for m in (model, features.EmbeddingModel.load(str(tmp_path / "e"))):
        for r in m.transform(docs).select("id", vector_to_array("features").alias("v")).collect():
            assert np.allclose(r["v"], want[r["id"]])


def test_oov_rate_shows_letter_case(docs, vectors):
    low = features.oov_rate(docs, vectors, tokenize("text")).first()
    cased = features.oov_rate(docs, vectors, tokenize("text", lower=False)).first()
    assert cased["missing"] > low["missing"] and low["tokens"] == cased["tokens"]


def test_fold_models_equal_models_fitted_on_the_other_folds(spark):
    words = ["a b c d", "a a b", "b c", "c d d e", "a e e", "b b b c"]
    docs = spark.createDataFrame([(i, w, i % 3) for i, w in enumerate(words)], "id int, text string, fold int")
    recipe = features.TfidfRecipe(min_times=2, max_tokens=3, stop=())
    fitted = recipe.fit_folds(docs, "fold", 3)
    wide, names = features.transform_folds(fitted, docs)
    for f in range(3):
        alone = recipe.fit(docs.filter(F.col("fold") != f))
        assert fitted[f].terms == alone.terms
        want = {r["id"]: r["features"] for r in alone.transform(docs).collect()}
        assert {r["id"]: r[names[f]] for r in wide.collect()} == want


def test_ngrams_of_a_text_in_one_row(spark, rows):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, None), (1, "b c d e")], "id int, text string")
    whole = dict(rows(tokens.ngrams(docs.filter("id <> 1"), n=3, keep_null=False, rows=False)))
    assert whole == {2: [], 3: []}
    apart = tokens.ngrams(docs, n=3, keep_null=False, rows=False).selectExpr("id", "explode(bigram) as bigram")
    assert sorted(rows(apart)) == sorted(rows(tokens.ngrams(docs, n=3, keep_null=False)))
