import itertools
import random
from collections import defaultdict

import pytest

from tests.llm.fixtures import documents, odd_rows
from textlabel.llm import passages


def brute(rows, min_words=20, threshold=0.8):
    units = defaultdict(list)
    for key, text in rows:
        for start, _, words in passages.paragraphs(text or "", min_words):
            units[" ".join(words)].append((key, start))
    sets = {u: passages.shingles(u.split(" "), 5) for u in units}
    root = {u: u for u in units}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(units, 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    classes = defaultdict(list)
    for u in units:
        classes[find(u)] += units[u]
    out = {}
    for spots in classes.values():
        if len({k for k, _ in spots if k is not None}) > 1:
            first = min(spots, key=lambda s: (s[0] is None, s))
            out |= {s: first for s in spots}
    return out


def found(df):
    return {(r.doc_id, r.start): (r.kept_id, r.kept_start) for r in df.collect()}


def variants(seed, groups, size, edits):
    """Documents with one paragraph each: groups of near copies that differ in some words."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), f"head {len(rows)}\n{' '.join(words)}\nlast line"))
    return rows


def test_banding_reaches_its_recall():
    for threshold in (0.5, 0.8, 0.95):
        rows, bands = passages.tune_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999
    assert passages.tune_bands(0.8) == (3, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = variants(seed, 8, 12, 3) + [(1000 + i, t) for i, t in variants(seed + 10, 1, 60, 4)]
    assert found(passages.repeated_passages(documents(spark, rows))) == brute(rows)


def test_odd_rows_and_long_lines(spark):
    shared = " ".join(f"Sentence {i} of the passage tells {i * 7} things about item{i} and its {i * 3} parts, end{i}." for i in range(9)) + " "
    filler = lambda k: " ".join(f"{k}f{i}{'.' if i % 7 == 0 else ''}" for i in range(90))
    rows = [*odd_rows(), (40, f"{filler('a')}. {shared}{filler('b')}"), (41, f"{filler('c')}. {shared}{filler('d')}")]
    got = found(passages.repeated_passages(documents(spark, rows), min_words=10))
    assert got == brute(rows, 10)
    assert {k for k, _ in got} >= {40, 41} and (None, 0) in got


def test_cutting_out(spark):
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"a\n{line}\nb"), (2, f"😀\n{line}\n{line}"), (3, "c"), (4, None), (None, line)]
    docs = documents(spark, rows)
    out = passages.without_passages(docs, passages.repeated_passages(docs))
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"a\n{line}\nb", 2: "😀\n\n", 3: "c", 4: None, None: ""}


def test_one_document_and_empty_table(spark):
    line = " ".join(f"word{i}" for i in range(30))
    assert found(passages.repeated_passages(documents(spark, [(1, f"{line}\n{line}"), (1, line)]))) == {}
    assert found(passages.repeated_passages(documents(spark, [(1, "x")]).filter("false"))) == {}


def shared_windows(rows, size=50):
    """(id, first word) of all windows of `size` words that another document holds too, and the spans of the words."""
    spots, spans = defaultdict(set), {}
    for key, text in rows:
        spans[key] = [m.span() for m in passages._TOKEN.finditer(text)]
        words = [text[a:b].lower() for a, b in spans[key]]
        for i in range(len(words) - size + 1):
            spots[tuple(words[i : i + size])].add((key, i))
    return [s for group in spots.values() if len({k for k, _ in group}) > 1 for s in group], spans


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window_of_fifty_shared_words_holds_a_unit(spark, seed):
    """Passages within lines, over many short lines, without punctuation or blanks, at both ends of a text and without end."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for n in (50, 51, 64, 120):
        for sep in (" ", "\n"):
            shared = sep.join(word() for _ in range(n))
            for before, after in ((12, 13), (0, 60), (45, 0)):
                parts = [" ".join(word() for _ in range(before)), shared, " ".join(word() for _ in range(after))]
                rows.append((len(rows), " ".join(p for p in parts if p)))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(50))
    for _ in range(2):
        rows.append((len(rows), "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(30)) + han + "。"))
    rows += [(len(rows), "same " * 300), (len(rows) + 1, "other " + "same " * 200)]
    windows, spans = shared_windows(rows)
    assert {k for k, _ in windows} == set(range(len(rows)))
    found_ = defaultdict(list)
    for r in passages.repeated_passages(documents(spark, rows)).collect():
        found_[r.doc_id].append((r.start, r.end))
    for key, i in windows:
        first, last = spans[key][i - 1][1] if i else 0, spans[key][i + 49][1]
        assert any(a >= first and b <= last for a, b in found_[key]), (key, i)


def test_overlapping_spans_are_cut_once(spark):
    docs = documents(spark, [(1, "a b c d e f")])
    cut = spark.createDataFrame([(1, 1, 9, True), (1, 2, 5, True)], "doc_id long, start int, end int, removed boolean")
    assert [r.text for r in passages.without_passages(docs, cut).collect()] == ["a f"]
