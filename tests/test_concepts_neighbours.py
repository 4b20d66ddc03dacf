import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabel.operators import concepts, neighbours

LEXICON = [
    ("Fentanyl", "fentanyl", "C1", "Organic Chemical"),
    ("fentanyl citrate", "fentanyl citrate", "C2", "Organic Chemical"),
    ("4-ANPP", "4-anpp", "C3", "Organic Chemical"),
    ("opioid", "opioid", "C4", "Pharmacologic Substance"),
    ("acute fentanyl citrate toxicity", "toxicity", "C5", "Finding"),
    ("heroin", "heroin", "C6", "Organic Chemical"),
    ("diamorphine", "heroin", "C7", "Organic Chemical"),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "alias string, entity string, cui string, semantic_type string")


@pytest.fixture(scope="module")
def notes(spark):
    texts = [
        ("1", "Acute fentanyl citrate toxicity; 4-ANPP, fentanyl."),
        ("2", "opioid use"),
        ("3", "nothing here"),
        ("4", None),
        ("5", "diamorphine then heroin, fentanyll"),
        ("6", "fentanyl, citrate"),
    ]
    return spark.createDataFrame(texts, "id string, text string")


def test_exact_mentions(notes, lexicon, rows):
    got = rows(concepts.annotate(notes, lexicon), "id", "pos", "cui")
    assert got == sorted(
        [("1", 0, "C5"), ("1", 1, "C1"), ("1", 1, "C2"), ("1", 5, "C3"), ("1", 9, "C1"), ("2", 0, "C4"),
         ("5", 0, "C7"), ("5", 2, "C6"), ("6", 0, "C1")], key=str,
    )


def test_first_mention_per_entity_and_collapse(notes, lexicon, rows):
    kept = concepts.filter_concepts(concepts.annotate(notes, lexicon), entities=["opioid"])
    assert rows(concepts.concept_strings(kept)) == [("1", "C1 C2 C3"), ("2", "C4"), ("5", "C7"), ("6", "C1")]


def grams3(s):
    return {s[i : i + 3] for i in range(max(len(s) - 2, 1))}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), size=rng.integers(1, 9))) for _ in range(120)} | {"fentanyl", "fentanyll"})
    left = spark.createDataFrame([(w,) for w in words[::2] + ["fentanyll"]], "gram string")
    right = spark.createDataFrame([(w,) for w in words[1::2] + ["fentanyl"]], "gram string")
    got = {(r["gram"], r["alias"]) for r in concepts.similar_grams(left, right, threshold).collect()}
    want = set()
    for a in {*words[::2], "fentanyll"}:
        for b in {*words[1::2], "fentanyl"}:
            x, y = grams3(a), grams3(b)
            if len(x & y) / len(x | y) >= threshold:
                want.add((a, b))
    assert got == want and want


def test_similar_mentions_find_a_misspelling(notes, lexicon):
    found = concepts.annotate(notes, lexicon, threshold=0.7)
    hit = found.filter("gram = 'fentanyll'").first()
    assert hit["cui"] == "C1" and 0.7 <= hit["score"] < 1
    assert found.filter("score = 1").count() == concepts.annotate(notes, lexicon).count()


def test_first_per_keeps_other_columns(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert rows(concepts.first_per(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 5, "z")]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 20, (6, 4))
    data = np.vstack([rng.normal(c, 1, (40, 4)) for c in centers] + [np.tile(centers[0], (80, 1))])  # a third are copies
    return data, spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(data)], "id int, vec array<double>, label int")


@pytest.mark.parametrize("block_rows", [16, 50, 4096])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_equals_brute_force(points, block_rows, exclude_self):
    data, df = points
    k = 4
    d = np.round(np.sqrt(((data[:, None, :] - data[None, :, :]) ** 2).sum(axis=2)), 9)
    got = {}
    for r in neighbours.knn(df, df, k, block_rows=block_rows, exclude_self=exclude_self).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["train_id"], r["dist"])
    for i in range(len(data)):
        order = sorted((j for j in range(len(data)) if not (exclude_self and i == j)), key=lambda j: (d[i, j], j))[:k]
        if exclude_self or d[i, order[-1]] > 0:
            assert [got[i][n + 1][0] for n in range(k)] == order
        assert np.allclose([got[i][n + 1][1] for n in range(k)], d[i, order])


def test_fewer_training_rows_than_k(points):
    _, df = points
    assert neighbours.knn(df.filter("id < 3"), df.filter("id < 2"), 5).count() == 6


@pytest.mark.parametrize("kernel", neighbours.KERNELS)
def test_votes_lie_between_zero_and_one(points, kernel):
    _, df = points
    near = neighbours.knn(df, df, 6, exclude_self=True)
    votes = neighbours.knn_vote(near, 5, kernel)
    assert votes.count() == df.count()
    assert votes.filter((F.col("p1") < 0) | (F.col("p1") > 1) | F.col("p1").isNull()).count() == 0


@pytest.mark.parametrize("shape", ["plain", "copies", "grid", "far", "few", "odd"])
def test_closest_equals_all_distances(shape):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(700, 8))
    if shape == "copies":
        points[::3] = points[0]
    elif shape == "grid":
        points = rng.integers(0, 3, (700, 4)).astype(float)
    elif shape == "far":
        points += 1e5
    elif shape == "few":
        points = points[:5]
    elif shape == "odd":
        points[7, 2] = np.nan
    best, dist = neighbours.closest(points[:90], points, 6)
    want, far = neighbours._every_distance(points[:90], points, 6)
    assert np.array_equal(best, want) and np.array_equal(dist, far, equal_nan=True)


def test_closest_works_out_few_distances(monkeypatch):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(4_000, 8))
    monkeypatch.setattr(neighbours, "_distances", None)  # the way that compares every row with every row
    best, _ = neighbours.closest(points[:50], points, 3)
    assert best[:, 0].tolist() == list(range(50))


def test_only_possible_grams_leave_the_task_and_none_is_lost(spark, lexicon, rows):
    rng = np.random.default_rng(5)
    words = ["fentanyl", "fentanyll", "citrate", "citrat", "heroine", "hero", "opioids", "acute", "toxicity", "4", "-", "ab", "é"]
    texts = [(i, " ".join(rng.choice(words, size=n))) for i, n in enumerate([0, 1, 3, 40, 900])] + [(None, "heroin"), (7, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    lex = concepts.normalise(lexicon)
    for threshold in (0.3, 0.7):
        grams = concepts.surface_grams(df, "id", "text", [1, 2, 3, 4])
        possible = concepts.possible_grams(df, "id", "text", [1, 2, 3, 4], concepts.Sieve.of(lex, threshold))
        every = set(rows(grams, "id", "pos", "n_words", "gram"))
        few = set(rows(possible, "id", "pos", "n_words", "gram"))
        assert few < every and len(few) == possible.count()
        assert {(r[0], r[1], r[3]) for r in few} >= {tuple(r) for r in grams.join(concepts.similar_grams(grams, lex, threshold), "gram").select("id", "pos", "gram").collect()}
        pairs = concepts.similar_grams(grams, lex, threshold)
        want = rows(grams.join(pairs.join(lex.withColumnRenamed("gram", "alias").drop("n_words"), "alias"), "gram"), "id", "pos", "gram", "cui", "score")
        assert rows(concepts.annotate(df, lexicon, threshold=threshold), "id", "pos", "gram", "cui", "score") == want and want


def test_a_large_lexicon_is_compared_with_all_grams(notes, lexicon, rows, monkeypatch):
    want = rows(concepts.annotate(notes, lexicon, threshold=0.7))
    monkeypatch.setattr(concepts, "MOST_PROBES", 2)
    assert concepts.Sieve.of(concepts.normalise(lexicon), 0.7) is None
    assert rows(concepts.annotate(notes, lexicon, threshold=0.7)) == want
