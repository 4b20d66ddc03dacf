"""Spelling variants, license rules and periodic runs against brute force, and what they make of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as registry
from tests.llm.fixtures import documents, odd_rows
from textlabel.llm import licenses, queries, runs, variants

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, factor=10):
    """By wildcard and deletion keys, checked against `near` for all pairs where the table is small."""
    out = {}
    spots = {}
    for w in n:
        for i in range(len(w)):
            spots.setdefault((w[:i], None, w[i + 1 :]), set()).add(w)
    for w in n:
        others = set()
        for i in range(len(w)):
            others |= spots[(w[:i], None, w[i + 1 :])]
            if w[:i] + w[i + 1 :] in n:
                others.add(w[:i] + w[i + 1 :])
        for i in range(len(w) + 1):
            others |= spots.get((w[:i], None, w[i:]), set())
        others.discard(w)
        if len(n) <= 300:
            assert others == {v for v in n if near(v, w)}
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (len(others), best if best is not None and n[best] >= factor * n[w] and n[best] > n[w] else None)
    rows = {}
    for w, (k, form) in out.items():
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        rows[w] = (n[w], k, form, n[form] if form is not None else None, root)
    return rows


def got_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_equal_all_pairs(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abÿ𝄞\0") for _ in range(r.randint(0, 6))): r.choice([0, 1, 2, 5, 30, 400, 5000]) for _ in range(280)}
    rows = [(w, n, "x") for w, n in words.items()] + [(None, 7, "x")]
    table = spark.createDataFrame(rows, "word string, n long, prefix string").repartition(5)
    assert got_variants(variants.spelling_variants(table)) == brute_variants(words)


def test_variants_chain_repeated_rows_and_empty(spark):
    rows = [("aaaaaaa", 1), ("aaaaaab", 6), ("aaaaaab", 5), ("aaaaabb", 200), ("aaaabbb", 4000), ("aaabbbb", None)]
    got = got_variants(variants.spelling_variants(spark.createDataFrame(rows, "w string, k int"), "w", "k"))
    assert got["aaaaaaa"] == (1, 1, "aaaaaab", 11, "aaaabbb") and got["aaabbbb"][4] == "aaaabbb" and got["aaaabbb"][2] is None
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_op11(spark):
    counts = Counter()
    for d in queries.table(spark, SF, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{d.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert got_variants(registry.queries()["op11_variants"](spark, SF)) == brute_variants(words)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_every_rule_is_reached_by_its_own_words():
    rules = licenses.signature_rules()
    assert len(rules) > 300
    for text, label in [
        ("Licensed under the Apache License, Version 2.0 (the 'License')", "apache-2"), ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3"),
        ("// SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("Released under the\n * MIT License.", "mit"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:", "bsd-2-clause"),
    ]:
        _, found = licenses.detect(text, tuple(rules))
        assert [rules[f[3]].label for f in found] == [label], text


def test_suppression_equals_pairwise_comparison():
    r = random.Random(5)
    for _ in range(300):
        found = list({(r.randrange(3), s, s + r.randint(1, 9), r.randrange(4)) for s in [r.randrange(20) for _ in range(r.randint(0, 25))]})
        beats = lambda a, b: a != b and a[1] <= b[1] and a[2] >= b[2] and (a[0] < b[0] or a[0] == b[0] and ((a[1], a[2]) != (b[1], b[2]) or a[3] < b[3]))  # noqa: E731, B023
        assert set(licenses.suppress(found)) == {f for f in found if not any(beats(g, f) for g in found)}


def test_phrases_overlap_and_stay():
    rules = tuple([*licenses.phrase_rules([("a b a", "x")]), licenses.Rule("y", licenses.SPDX, ("b",), "a b a b a")])
    _, found = licenses.detect("A b, a b a ba", rules)
    assert [(rules[k].label, a, b) for _, a, b, k in found] == [("x", 0, 3), ("y", 0, 5), ("x", 2, 5)]


def test_op12(spark):
    docs = {d.doc_id: d.text for d in queries.table(spark, SF, "documents").collect()}
    for r in registry.queries()["op12_licenses"](spark, SF).collect():
        w = words_of(docs[r.doc_id])
        places = [(i, label) for phrase, label in queries.LICENSE_PHRASES for k in [phrase.split()] for i in range(len(w)) if w[i : i + len(k)] == k]
        starts, base = [i for i, _ in places], sorted({label for _, label in places})
        want = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def brute_runs(w, min_length=6, e=4):
    out, n = [], len(w)
    for q in range(1, n // e + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(min_length, e * q) and not any(all(w[s + t] == w[s + t - p] for t in range(p, size)) for p in range(1, q)):
                out.append((s, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3), (1, 2)])
def test_runs_equal_brute_force(limits):
    r = random.Random(1)
    for _ in range(700):
        n, k = r.randint(0, 60), r.choice([1, 2, 3, 5, 20])
        w = [b"%d" % r.randrange(k) for _ in range(n)]
        if r.random() < 0.5 and n > 6:
            a, p = r.randrange(n), r.randint(1, n // 3)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert runs.find_runs(w, *limits) == brute_runs(w, *limits)


def test_fibonacci_word_and_one_long_run():
    a, b = [b"x"], [b"x", b"y"]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.find_runs(b, 2, 2) == brute_runs(b, 2, 2)
    assert runs.find_runs([b"%d" % (i % 500) for i in range(20_000)]) == [(0, 20_000, 500)]
    with pytest.raises(ValueError):
        runs.find_runs(b, 2, 1)


def test_op13(spark):
    docs = {d.doc_id: d.text for d in queries.table(spark, SF, "documents").collect()}
    hit = 0
    for r in registry.queries()["op13_runs"](spark, SF).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:  # brute force is quadratic
            continue
        found = brute_runs(w)
        hit += len(found)
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        milli = 1000 * top[1] // top[2] if found else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *top, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in found))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert hit > 10


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    rules = licenses.signature_rules()
    for df, cols in ((licenses.find_licenses(docs, rules), 3), (runs.periodic_runs(docs), 3)):
        assert df.count() == len(odd_rows()) and len(df.columns) == len(docs.columns) - 1 + cols
    found = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert found[3]["runs_"] == [] if "runs_" in found[3] else found[3]["runs"] == []
    assert found[3]["collapsed"] == "" and found[4]["n_words"] == 0
    empty = docs.limit(0)
    assert licenses.find_licenses(empty, rules).count() == 0 and runs.periodic_runs(empty).count() == 0
