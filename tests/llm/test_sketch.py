import random
import statistics

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, odd_rows
from textlabel.llm import sketch


def edit(text, other):
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


@pytest.mark.parametrize("per_bucket", [1024, 3, 1])
def test_next_and_edits_of_odd_rows(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(sketch, "ROWS_PER_BUCKET", per_bucket)
    rows = odd_rows() + [(1000 + 7 * i, f"text {i} " * (i + 1)) for i in range(30)]
    got = sketch.compare_with_edits(documents(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = [(i, t, edit(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order)]
    known = lambda x: sorted(r for r in x if r[0] not in (2, None))  # noqa: E731  2 is there twice, rows without id follow each other in any order
    assert len(got) == len(rows)
    assert known((r.doc_id, r.text, r.edited) for r in got) == known(want)


def test_single_document_follows_itself(spark):
    r = sketch.compare_with_edits(documents(spark, [(4, "abcdefgh")])).first()
    assert r.edited == "abcdefab" and r.sketch == r.next_sketch
    assert sketch.compare_with_edits(documents(spark, [(4, "a")]).filter("false")).collect() == []


def test_sketch_is_the_low_end_of_all_hashes(spark):
    words = [f"w{i}" for i in range(400)]
    df = documents(spark, [(1, " ".join(words)), (2, "A b"), (3, ""), (4, None), (5, "a\n B"), (6, " ".join(words[:200]))])
    all_of = {r.doc_id: r for r in df.select("doc_id", sketch.sketch(F.col("text"), one_in=1).alias("s"), sketch.sketch(F.col("text"), one_in=8).alias("t")).collect()}
    limit = -(1 << 63) + (1 << 61)
    assert len(all_of[1].s) == 396
    assert all_of[1].t == [h for h in all_of[1].s if h < limit] and all_of[1].t == sorted(all_of[1].t)
    assert all_of[2].t == all_of[5].t and len(all_of[2].t) == 1 and all_of[3].t == all_of[4].t == []
    assert set(all_of[6].t) <= set(all_of[1].t)  # a part's sketch is in that of the whole
    first = xxhash.xxh64_intdigest(b"w0", 42)
    one = df.filter("doc_id = 1").select(F.xxhash64(F.lit("w0")).alias("h")).first().h
    assert one % (1 << 64) == first


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(40):
        whole = [f"t{rng.randrange(10**6)}" for _ in range(2000)]
        part = whole[: rng.randrange(200, 1900)]
        rows += [(2 * i, " ".join(whole)), (2 * i + 1, " ".join(part))]
        truth[2 * i] = (len(part) - 4) / (len(whole) - 4)
    pairs = sketch.with_next(documents(spark, rows).select("doc_id", sketch.sketch(F.col("text")).alias("s")), "doc_id", ["s"])
    near = pairs.select("doc_id", sketch.likeness(F.col("s"), F.col("next_s")).alias("j"), sketch.containment(F.col("next_s"), F.col("s")).alias("c"))
    got = {r.doc_id: r for r in near.collect()}
    assert statistics.mean(abs(got[i].j - t) for i, t in truth.items()) < 0.04
    assert all(got[i].c == 1.0 for i in truth)


def test_likeness_bounds(spark):
    rows = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 1]), ([1], [2])], "a array<bigint>, b array<bigint>")
    assert [r.j for r in rows.select(sketch.likeness(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, 1.0, 0.0]
