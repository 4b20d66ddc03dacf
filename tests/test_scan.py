import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlabel.operators import concepts, scan


def places(words, aliases):
    return sorted((i, len(a), " ".join(a)) for i in range(len(words)) for a in aliases if words[i : i + len(a)] == a)


def longest(found):
    out, free = [], 0
    for pos, n, name in sorted(found, key=lambda m: (m[0], -m[1])):
        if pos >= free:
            out.append((pos, n, name))
            free = pos + n
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    aliases = sorted({tuple(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(60)} - {("b",), ("c",)})
    aliases = [list(a) for a in aliases] + [["a"] * 45]
    texts = [[rng.choice("abcdx") for _ in range(rng.randrange(60))] for _ in range(40)] + [["a"] * 100, [], None]
    left = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>").repartition(3)
    right = spark.createDataFrame([(" ".join(a), a) for a in aliases] + [("none", []), ("null", None)], "alias string, words array<string>")
    return left, right, {i: t or [] for i, t in enumerate(texts)}, aliases


@pytest.mark.parametrize("overlaps", ["all", "longest"])
@pytest.mark.parametrize("max_bytes", [1 << 20, 1500])
def test_against_every_place_and_alias(tables, overlaps, max_bytes, monkeypatch):
    monkeypatch.setattr(scan, "WORDS_AT_ONCE", 64)
    left, right, texts, aliases = tables
    got = sorted(map(tuple, scan.scan_aliases(left, right, overlaps, max_bytes).collect()))
    want = {i: places(t, aliases) for i, t in texts.items()}
    assert got == sorted((i, *m) for i, found in want.items() for m in (found if overlaps == "all" else longest(found)))


def test_the_lexicon_is_split_by_first_word(tables):
    assert scan.measured_bytes(tables[1].filter(F.size("words") > 0)) > 2 * 1500


def test_scan_equals_the_join_on_forty_lengths(spark, rows):
    words = [f"w{i % 7}" for i in range(60)]
    lexicon = spark.createDataFrame([(" ".join(words[:n]), f"e{n}", f"C{n}", "x") for n in range(1, 41)] + [("w3", "e", "C", "x"), ("W3", "f", "D", "y"), ("", "g", "E", "z")], "alias string, entity string, cui string, semantic_type string")
    notes = spark.createDataFrame([("1", " ".join(words)), ("2", "W0 w1, w2"), ("3", None), ("4", ""), ("1", "w3")], "id string, text string")
    lex = concepts.normalise(lexicon)
    grams = concepts.surface_grams(notes, "id", "text", range(1, 41))
    want = rows(grams.join(lex.drop("n_words"), "gram").select("id", "pos", "gram", *concepts.CONCEPT))
    assert rows(concepts.scan(notes, lexicon)) == want
    assert rows(concepts.annotate(notes, lexicon).drop("score")) == want


def test_empty_sides(spark, tables):
    left, right, _, _ = tables
    assert scan.scan_aliases(left.filter("false"), right).count() == 0
    assert scan.scan_aliases(left, right.filter("false")).count() == 0
    with pytest.raises(ValueError):
        scan.scan_aliases(left, right, "some")


def test_a_batch_is_scanned_in_pieces_of_bounded_size():
    lists = [["a"] * n for n in (3, 0, 4, 50, 1, 1)] + [None] + [["b"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], names=["id", "words"])
    got = list(scan.pieces(batch, 8))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert list(scan.pieces(batch.slice(0, 0), 8)) == []
    trie, names = scan.Trie([["a", "a"], ["b"]]), pa.array(["aa", "b"])
    (whole,) = scan._scan(trie, names, True)(iter([batch]))
    scan_words, scan.pieces.__defaults__ = scan.pieces.__defaults__, (8,)
    try:
        parts = list(scan._scan(trie, names, True)(iter([batch])))
    finally:
        scan.pieces.__defaults__ = scan_words
    spots = lambda b: sorted(map(str, b.to_pylist()))
    assert len(parts) == 4 and spots(pa.Table.from_batches(parts)) == spots(whole)
