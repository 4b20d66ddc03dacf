import numpy as np

from tests.llm.fixtures import documents, odd_rows, with_clashes
from textlabel.llm import language, quality

TEXT = {
    "en": "the house of the rising sun was there when they went with another thing that nobody thought about",
    "de": "das haus der aufgehenden sonne war nicht mehr da als sie mit einer anderen sache über die straße gingen",
    "fr": "la maison du soleil levant était là quand ils sont allés avec une autre chose à laquelle personne ne pensait",
}


def learned(spark):
    rows = [(i, lang, " ".join(np.roll(t.split(), i))) for i in range(12) for lang, t in TEXT.items()]
    df = spark.createDataFrame([*rows, (90, None, "zzz zzz"), (91, "en", None), (92, "en", "")], "doc_id long, lang string, text string")
    return language.fit(with_clashes(df), bits=16)


def test_exact_gram_numbers():
    gram, at = language.grams(["Ab", "", "ß 1 c"])
    text = lambda x: "".join(chr(int(x) >> s & 0x1FFFFF) for s in (42, 21, 0))
    assert [(text(g), int(i)) for g, i in zip(gram, at)] == [(" ab", 0), ("ab ", 0), (" ß ", 2), ("ß c", 2), (" c ", 2)]


def test_filter_against_plain_sets(spark):
    model = learned(spark)
    assert model.languages == ["de", "en", "fr"]
    own = {lang: set(language.grams([" ".join(np.roll(t.split(), i)) for i in range(12)])[0].tolist()) for lang, t in TEXT.items()}
    counts = {lang: language.grams([" ".join(np.roll(t.split(), i)) for i in range(12)])[0].tolist() for lang, t in TEXT.items()}
    rate = lambda lang, g: counts[lang].count(g) / len(counts[lang])
    probe = ["the sun und la maison", "straße", "qqq xxx"]
    found, total = model.hits(probe)
    false = model.false_rates()
    for i, text in enumerate(probe):
        gram = language.grams([text])[0].tolist()
        assert total[i] == len(gram)
        for k, lang in enumerate(model.languages):
            top = lambda g: max(rate(x, g) for x in TEXT)
            exact = sum(g in own[lang] and rate(lang, g) >= 0.25 * top(g) for g in gram)
            assert exact <= found[i, k] <= exact + max(1, 5 * false[k] * len(gram))


def test_predictions(spark):
    docs = documents(spark, [*odd_rows(), (50, "über das haus"), (51, "the thing"), (52, "la chose était"), (53, "12 ?!")])
    out = {r.doc_id: r for r in language.identify(docs, learned(spark)).collect()}
    assert [out[i].lang_pred for i in (50, 51, 52, 53, 3, 4, 5, 11)] == ["de", "en", "fr", *["und"] * 5]
    assert all(0 <= r.score <= 1 for r in out.values()) and out[53].score == 0
    none = language.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.filter("false"), none).collect() == []


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "stmkr" for b in ("ar", "en", "il", "ot") for c in ("ing", "ed", "er", "a")]
    rows = []
    for i in range(n):
        good = " ".join(rng.choice(words, 80))
        rows.append((i, good, 1) if i % 3 else (i, " ".join(f"{w.upper()}!!###" for w in good.split()), 0))
    return with_clashes(spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, quality int"))


def test_quality_separates_and_keeps_columns(spark):
    df = labelled(spark)
    model = quality.fit(df, df)
    docs = df.drop("score")
    out = quality.with_score(docs, model)
    assert out.columns == [*docs.columns, "score"]
    rows = [r for r in out.collect() if r.quality is not None and r.text]
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.98
    again = quality.fit(df, df)
    assert (again.good, again.bad, again.weights) == (model.good, model.bad, model.weights)


def test_quality_without_a_label_and_of_odd_rows(spark):
    only = labelled(spark).filter("quality = 1")
    model = quality.fit(only, only)
    docs = documents(spark, odd_rows()).drop("score")
    scores = [r.score for r in quality.with_score(docs, model).collect()]
    assert len(scores) == len(odd_rows()) and all(s == scores[0] > 0.9 for s in scores)
    none = quality.fit(only, only.filter("false"))
    assert quality.with_score(docs, none).first().score == 0.5
    assert quality.with_score(docs.filter("false"), none).collect() == []


def test_bounded_samples_keep_the_balance(spark):
    df = labelled(spark, 600)
    docs = df.drop("score")
    rows = [r for r in quality.with_score(docs, quality.fit(df, df, samples=40, calibration_rows=60)).collect() if r.quality is not None and r.text]
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95


def test_blocks_cover_the_whole_text():
    good, bad = b"alpha beta gamma " * 50, b"### !!! ###"
    start, late = quality.features(["alpha " * 3000 + "### " * 9000, "alpha " * 3000], good, bad)
    assert start[2] != late[2]
    assert quality.features([None, ""], good, bad).tolist() == [[0.0] * 3] * 2
