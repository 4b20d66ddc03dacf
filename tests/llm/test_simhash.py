import random

import pyarrow as pa
import pytest
import xxhash

from tests.llm.fixtures import documents, odd_rows
from textlabel.llm import simhash
from textlabel.llm.components import connected_components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_stars_and_ties(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    links += [(5, 5), (100, 101), (101, 100)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = classes({x for pair in links for x in pair}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints_and_classes_of_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.fp) for r in got) == sorted((i or -1, signed(brute_fingerprint(t))) for i, t in rows)
    fps = {brute_fingerprint(t) for _, t in rows}
    links = [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 2]
    root = classes(fps, links)
    for r in got:
        group = [i for i, t in rows if i is not None and root[brute_fingerprint(t)] == root[r.fp % (1 << 64)]]
        assert r.component_id == (min(group) if group else None)


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("paired", [1, 4, 32])
def test_links_against_all_pairs(spark, monkeypatch, distance, paired):
    """Clusters of one and two bits, some so large that the exact path by centres takes over."""
    monkeypatch.setattr(simhash, "PAIRED_RUN", paired)
    rng = random.Random(distance)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(14):
            x = centre
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.near_links(df, distance).collect()}
    assert all(((a ^ b) % (1 << 64)).bit_count() <= distance for a, b in got)
    nodes = {signed(x) for x in fps}
    want = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) % (1 << 64)).bit_count() <= distance]
    assert classes(nodes, got) == classes(nodes, want)


@pytest.mark.parametrize("size", range(60, 71))
@pytest.mark.parametrize("batch", [1, 7, 60, 64, 65, 66, 100])
def test_no_member_of_a_long_run_is_compared_in_part(size, batch):
    """A run is reported as crowd whole, wherever batches end in it; its members differ so much that no pair is near."""
    rng = random.Random(size)
    fps = [0, *(rng.getrandbits(64) for _ in range(size)), 1]
    rows = [(0, 0, 5, fps[0]), *((0, 1, 7, x) for x in fps[1:-1]), (1, 0, 9, fps[-1])]
    cols = [pa.array(c, t) for c, t in zip(zip(*((a, b, r, signed(x)) for a, b, r, x in rows)), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
    table = pa.RecordBatch.from_arrays(cols, names=["seg", "pos", "rest", "fp"])
    parts = (table.slice(i, batch) for i in range(0, len(rows), batch))
    out = [r for b in simhash._compare_runs(2)(parts) for r in b.to_pylist()]
    assert {r["a"] for r in out if r["b"] is None} == {signed(x) for x in fps[1:-1]}


def test_one_of_each_class_stays(spark):
    docs = documents(spark, odd_rows())
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 2 repeats 1, 4 and 5 have no words like 3; the rows without an id cannot be told apart and stay.
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and ids.count(None) == 2
    again = documents(spark, [(1, "x y z"), (1, "x y z"), (2, "x y z")])
    assert [r.doc_id for r in simhash.keep_one(again, simhash.near_duplicates(again)).collect()] == [1]


def test_empty_table(spark):
    empty = documents(spark, [(1, "x")]).filter("false")
    assert simhash.near_duplicates(empty).collect() == []
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([], "fp long"), 3)
