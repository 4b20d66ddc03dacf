"""SimHash near-duplicates: fingerprints that differ in a bit or two, found by one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.llm.components import connected_components
from textlabel.llm.names import column, fresh
from textlabel.session import settle

BITS = 64
# Longest run of one variant that is compared pair by pair; members of longer runs take the exact path by centres.
PAIRED_RUN = 32
_HASHES_AT_ONCE = 1 << 16
# Bits are counted by the byte values in each of the eight columns.
_COLUMN = np.arange(8, dtype=np.int64) * 256
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number.

    A-Z become lower case; words are what ASCII white space separates; shingles of `width` words, repeats
    included, are joined by blanks (the whole sequence if there are fewer words). A bit is 1 if it is set
    in over half of the shingles' hashes. NULL and texts without words give 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    counts, left = np.zeros(2048, np.int64), n
    while left:
        part = min(left, _HASHES_AT_ONCE)
        hashes = np.array([xxhash.xxh64_intdigest(g, seed) for g in islice(grams, part)], "<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
        left -= part
    set_bits = (counts.reshape(8, 256) @ _BITS_OF_BYTE).ravel()
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each text as a signed 64-bit number. Row-local."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(each, schema)


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of so few segments that among `max_distance` differing bits one segment has at most one."""
    count = max_distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def wildcard_variants(fps: DataFrame, max_distance: int) -> DataFrame:
    """(seg, pos, rest, fp): each segment with each one of its bits taken out."""

    def cut(lo: int, width: int, pos: int) -> Column:
        keep = ((1 << width) - 1 ^ (1 << pos)) << lo
        return F.col("fp").bitwiseAND(F.lit(keep - (1 << 64) if keep >> 63 else keep))

    rows = [
        F.struct(F.lit(s).alias("seg"), F.lit(p).alias("pos"), cut(lo, width, p).alias("rest"))
        for s, (lo, width) in enumerate(_segments(max_distance))
        for p in range(width)
    ]
    return fps.select("fp", F.explode(F.array(*rows)).alias("v")).select("v.*", "fp")


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _compare_runs(max_distance: int):
    """Rows sorted by variant in, links out: (a, b) for a pair within `max_distance`, (a, NULL) for each
    member of a run too long to be compared pair by pair. A pair is given at the first variant it shares."""
    segments = _segments(max_distance)
    masks = [np.uint64(((1 << width) - 1) << lo) for lo, width in segments]

    def links(seg, pos, rest, fp):
        new = np.ones(len(fp), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (pos[1:] != pos[:-1]) | (rest[1:] != rest[:-1])
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        long = size[run] > PAIRED_RUN
        out = [(fp[long], None)]
        for step in range(1, min(PAIRED_RUN, int(size.max(initial=1)))):
            i = np.nonzero((run[step:] == run[:-step]) & ~long[:-step])[0]
            x, y, s, p = fp[i], fp[i + step], seg[i], pos[i]
            diff = x ^ y
            near = _bit_count(diff) <= max_distance
            first = np.zeros(len(i), bool)
            open_ = np.ones(len(i), bool)
            for k, (lo, _) in enumerate(segments):
                d = diff & masks[k]
                at = np.where(d == 0, p == 0, d == np.left_shift(np.uint64(1), (p + lo).astype(np.uint64)))
                first |= open_ & (s == k) & at
                open_ &= _bit_count(d) > 1
            keep = near & first
            out.append((x[keep], y[keep]))
        return out

    def batch_of(out):
        a = np.concatenate([x for x, _ in out]).view(np.int64)
        b = np.concatenate([np.zeros(len(x), np.int64) if y is None else y.view(np.int64) for x, y in out])
        none = np.concatenate([np.full(len(x), y is None) for x, y in out])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none)], names=["a", "b"])

    def columns(batch):
        seg, pos, rest, fp = (batch.column(i).to_numpy() for i in range(4))
        return seg, pos, rest.view(np.uint64), fp.view(np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = columns(batch)
            if held is not None:
                now = tuple(np.concatenate([h, x]) for h, x in zip(held, now))
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            start = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))
            # A long run: its earlier members are reported at once. Both parts must be longer than what is compared pair by pair.
            if len(same) - start > 2 * PAIRED_RUN + 1:
                body, tail = slice(0, len(same) - PAIRED_RUN - 1), slice(len(same) - PAIRED_RUN - 1, None)
            else:
                body, tail = slice(0, start), slice(start, None)
            if body.stop:
                yield batch_of(links(*(x[body] for x in now)))
            held = tuple(x[tail] for x in now)
        if held is not None and len(held[0]):
            yield batch_of(links(*held))

    return each


def near_links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column `fp`) that differ in at most `max_distance` bits,
    enough of them to connect all that are linked.

    Equal variants meet in one run of a sorted partition, and pairs of a run are verified by their bits.
    Where a variant is shared by many fingerprints (large groups of near copies) not all pairs are made:
    two fingerprints within two bits have a common neighbour within one bit, so each member of such a
    run is sent to its 65 neighbours. No neighbour has more than 65 of them, all within two bits of each other.
    """
    if max_distance not in (1, 2):
        raise ValueError("max_distance must be 1 or 2")
    variants = wildcard_variants(fps, max_distance)
    runs = variants.repartition("seg", "pos", "rest").sortWithinPartitions("seg", "pos", "rest", "fp")
    found = settle(runs.mapInArrow(_compare_runs(max_distance), "a long, b long"), "simhash-links")
    crowd = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    flips = [F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)]]
    centres = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("centre"))
    balls = centres.groupBy("centre").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    if max_distance == 1:
        balls = balls.filter(F.array_contains("near", F.col("centre")))
        hub = F.col("centre")
    else:
        hub = F.array_min("near")
    starred = balls.select(hub.alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return found.filter("b is not null").unionByName(starred)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_distance: int = 2
) -> DataFrame:
    """(id_col, fp, component_id): one row per document; documents are linked whose fingerprints differ in at
    most `max_distance` bits, and `component_id` is the smallest id that can be reached.

    NULL and wordless texts have fingerprint 0 and are linked like others. Equal texts, repeated rows
    and repeated ids are grouped before any search. A NULL id takes part and gets its group's smallest
    known id, NULL if there is none. An empty table gives no rows. Other columns of `docs` are not read.
    """
    prints = settle(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    roots = connected_components(near_links(distinct.select("fp"), max_distance))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = grouped.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = prints.join(classes, F.col("fp") == F.col("_fp"))
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stand for their class: those whose id is the class's component id.

    Of rows that repeat an id one stays. A row without id stays, as nothing tells which row of its class it is."""
    key, away, more = column(id_col), fresh(docs, "gone"), fresh(docs, "again")
    gone = classes.filter(key != F.col("component_id")).select(key.alias(away)).distinct()
    kept = docs.join(gone, key == F.col(away), "left_anti")
    ids = classes.filter(key == F.col("component_id")).groupBy(key.alias(more))
    again = settle(ids.agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(more), "repeated-ids")
    if again.isEmpty():
        return kept
    same = key == F.col(more)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col]))
