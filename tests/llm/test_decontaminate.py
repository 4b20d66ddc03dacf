import random
import re

import pytest

from tests.llm.fixtures import documents, odd_rows, with_clashes
from textlabel.llm import decontaminate


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, length):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            size = min(length, len(b))
            grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
            for i in range(len(w) - size + 1) if b else ():
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(item)
        out.append((key, len(w), len(hit), sorted(x for x in found if x is not None), bool(hit)))
    return sorted(out, key=str)


def items(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "item_id long, text string"))


@pytest.mark.parametrize("inline", [True, False])
def test_against_brute_force(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(decontaminate, "SET_BYTES", -1)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "x1", "é", "Δ"]) for _ in range(n))
    tests = [(i, text(n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 25])] + [(20, None), (21, " .,"), (22, "alone"), (None, "odd pair")]
    docs = odd_rows() + [(100 + i, text(40)) for i in range(25)]
    docs += [(200, f"{tests[0][1]}! {tests[2][1].upper()}"), (201, "an odd-pair alone"), (202, tests[6][1] * 3)]
    got = decontaminate.contamination(documents(spark, docs), items(spark, tests))
    rows = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, tests, 10)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7, 8, 13])
def test_window_lengths(spark, length):
    docs = [(1, "a b c d e f g h i j k l m n o p"), (2, "b a c d e f g h i j k l m n o p q"), (3, "p o n")]
    tests = [(7, "c d e f g h i j k l m n o"), (8, "o n")]
    got = decontaminate.contamination(documents(spark, docs), items(spark, tests), length=length)
    rows = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, tests, length)


def test_false_hash_hits_are_verified(spark, monkeypatch):
    """With a hash that takes all windows for one, only equal words count."""
    from pyspark.sql import functions as F

    flat = lambda h, length: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (length - 1), F.lit(0))), lambda x: F.lit(5).cast("long"))
    monkeypatch.setattr(decontaminate, "window_hashes", flat)
    docs, tests = [(1, "a b c d"), (2, "w x y z"), (3, "")], [(9, "b c")]
    got = decontaminate.contamination(documents(spark, docs), items(spark, tests)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == brute(docs, tests, 10)


def test_empty_tables(spark):
    docs = documents(spark, odd_rows())
    none = items(spark, [(1, "x")]).filter("false")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(docs.filter("false"), items(spark, [(1, "x")])).collect() == []
