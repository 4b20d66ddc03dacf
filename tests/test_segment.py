import itertools
import math
import random

import pytest

from textlabel.operators import segment


def all_paths(run):
    for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        words, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(run[last:i])
                last = i
        yield words + [run[last:]] if run else []


@pytest.mark.parametrize("seed", range(5))
def test_best_path_equals_all_paths(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(25)}
    lexicon = segment.Lexicon(words)
    cost = lambda p: sum(lexicon.costs.get(w, lexicon.unknown if len(w) == 1 else math.inf) for w in p)
    for _ in range(30):
        run = "".join(rng.choice("abcx") for _ in range(rng.randrange(1, 10)))
        got, want = lexicon.cut(run), min(all_paths(run), key=lambda p: (round(cost(p), 6), len(p)))
        assert "".join(got) == run and cost(got) == pytest.approx(cost(want)) and len(got) == len(want)


def test_words_are_learned_from_runs(spark, rows):
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(300)]
    words = ["".join(rng.sample(letters, rng.choice([1, 2, 2, 3]))) for _ in range(60)]
    texts = [[rng.choice(words) for _ in range(rng.randrange(3, 15))] for _ in range(600)]
    docs = [(i, f"no. {i}: {''.join(t)}。") for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "plain"), (1003, "鿾" * 3000)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    lexicon = segment.Lexicon.learn(segment.letter_runs(df), max_len=4)
    got = dict(rows(lexicon.segment(df)))
    ends = lambda ws: set(itertools.accumulate(map(len, ws)))
    hit = sum(len(ends(got[i]) & ends(t)) for i, t in enumerate(texts))
    assert hit >= 0.95 * sum(map(len, texts)) and hit >= 0.9 * sum(len(got[i]) for i in range(len(texts)))
    assert got[1000] == got[1001] == got[1002] == [] and "".join(got[1003]) == "鿾" * 3000


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "id long, text string")
    lexicon = segment.Lexicon.learn(segment.letter_runs(empty))
    assert lexicon.costs == {} and lexicon.cut("ab") == ["a", "b"] and lexicon.segment(empty).count() == 0


def test_batches_cut_like_single_runs():
    rng = random.Random(11)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 50) for _ in range(120)}
    lexicon = segment.Lexicon(words)
    runs = ["".join(rng.choice("abcdex𠀀") for _ in range(rng.randrange(0, 60))) for _ in range(400)] + [None, "", "ab" * 150, "a" * 200, "ab" * 150]
    assert lexicon.cut_all(runs) == [lexicon.cut(run) for run in runs]
    assert segment.Lexicon({}).cut_all(["ab", None] * 30) == [["a", "b"], []] * 30


@pytest.mark.parametrize("max_words", [40, 10_000])
def test_candidates_are_those_of_a_full_count(spark, monkeypatch, max_words):
    rng = random.Random(5)
    parts = ["ab", "cde", "fab", "c", "dd", "𠀀b"]
    runs = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))), rng.randrange(1, 4)) for _ in range(150)] + [("", 5), (None, 2)]
    monkeypatch.setattr(segment, "HELD", 50)
    counts = {}
    for run, n in runs:
        for i, j in itertools.combinations(range(len(run or "") + 1), 2):
            if j - i <= 9:
                counts[run[i:j]] = counts.get(run[i:j], 0) + n
    kept = sorted(((w, n) for w, n in counts.items() if n >= 5 or len(w) == 1), key=lambda x: (-x[1] * len(x[0]), x[0].encode()))[:max_words]
    lexicon = segment.Lexicon.learn(spark.createDataFrame(runs, "run string, n long"), max_len=9, max_words=max_words, rounds=0)
    assert lexicon.costs == pytest.approx(segment.Lexicon(dict(kept)).costs)
