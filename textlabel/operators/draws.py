"""Bootstrap replicates of exactly n draws: n is split down a hash tree by conditional binomials."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.operators.resample import replicate_ids
from textlabel.session import settle

# Most levels of the tree whose counts the tasks get: 2^14 counts, 128 kB, whatever the number of rows.
TOP = 14
# A part with more rows is split further down by the next bits, so that a matrix of (replicate, row) stays small.
ROWS_AT_ONCE = 256


def top_counts(counts: np.ndarray) -> list[np.ndarray]:
    """Rows below each node, level by level from the root, of the counts of the lowest nodes."""
    levels = [counts]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2).sum(1))
    return levels


def halve(total: np.ndarray, left: int, right: int, key: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Draws (replicate) of a node shared between its halves, by a generator of the node's own."""
    if not left or not right:
        return (total, np.zeros_like(total)) if left else (np.zeros_like(total), total)
    first = np.random.default_rng(key).binomial(total, left / (left + right))
    return first, total - first


def draws_of(node: int, levels: Sequence[np.ndarray], replicates: int, seed: int, path: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """Draws (replicate) that fall to a lowest node. `path` keeps the way to the last node: the next one shares most of it."""
    depth = len(levels) - 1
    if 0 not in path:
        path[0] = 0, np.full(replicates, int(levels[0][0]))
    for level in range(depth):
        at, child = node >> (depth - level), node >> (depth - level - 1)
        if path.get(level + 1, (-1,))[0] != child:
            below = levels[level + 1][2 * at : 2 * at + 2]
            halves = halve(path[level][1], int(below[0]), int(below[1]), [seed, level, at])
            path[level + 1] = child, halves[child & 1]
    return path[depth][1]


def share_out(total: np.ndarray, keys: np.ndarray, bit: int, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Weights (row, replicate) of rows in order of their unsigned keys, a few hundred rows at a time. Rows whose
    keys agree are halved by their place."""
    stack = [(0, len(keys), bit, total)]
    while stack:
        start, stop, bit, total = stack.pop()
        rows = stop - start
        if rows <= ROWS_AT_ONCE:
            rng = np.random.default_rng([seed, 99, bit, start, int(keys[start])])
            yield slice(start, stop), rng.multinomial(total, np.full(rows, 1 / rows)).T
            continue
        if bit < 64:
            mask = np.uint64(1) << np.uint64(63 - bit)
            cut = start + int(np.searchsorted((keys[start:stop] & mask) > 0, True))
        else:
            cut = start + rows // 2
        first, second = halve(total, cut - start, stop - cut, [seed, 98, bit, start, int(keys[start])])
        if cut < stop:
            stack.append((cut, stop, bit + 1, second))
        if cut > start:
            stack.append((start, cut, bit + 1, first))


def exact_weights(df: DataFrame, id_col: str, replicates: int = 1000, seed: int = 100) -> DataFrame:
    """Add `weights`, how often the row is drawn in each of the replicates 1, 2, … when n of n rows are drawn with
    replacement: each replicate sums to n, and the weights of the rows are multinomial.

    A row's place in the tree is a hash of its id (NULL has one, too), so the weights are a pure function of the seed and the
    ids. Rows of one id differ by a hash of all their columns; equal rows are interchangeable. One count by hash bucket,
    of which the tasks get 2^14 numbers, and one shuffle of the rows by bucket: pass narrow rows. A bucket is held in
    one task, so ids should be (nearly) unique.
    An empty table gives an empty table. Clashing names: a column `weights` of the input is an error.
    """
    if "weights" in df.columns:
        raise ValueError("the table has a column `weights`")
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"))
    whole = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema]
    keyed = settle(df.select("*", key.alias("_key"), F.xxhash64(*whole).alias("_tie")), "draw-keys")
    top = min(TOP, max(0, int(keyed.count() // ROWS_AT_ONCE).bit_length()))
    keyed = keyed.withColumn("_node", F.shiftrightunsigned("_key", 64 - top).cast("int") if top else F.lit(0))
    counts = np.zeros(2**top, np.int64)
    for node, n in keyed.groupBy("_node").count().collect():
        counts[node] = n
    levels = top_counts(counts)
    names = list(df.columns)
    width = len(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: dict[int, tuple[int, np.ndarray]] = {}
        for node, table in _by_node(batches, width + 2):
            total = draws_of(node, levels, replicates, seed, path)
            keys = table.column(width).to_numpy().astype(np.int64).view(np.uint64)
            for rows, weights in share_out(total, keys, top, seed):
                part = table.slice(rows.start, rows.stop - rows.start).combine_chunks()
                flat = pa.array(np.ascontiguousarray(weights).reshape(-1).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(weights) + 1, dtype=np.int32) * replicates), flat)
                for batch in part.select(range(width)).to_batches():
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "weights"])

    # Order by the key as an unsigned number: the node holds its upper bits.
    ordered = keyed.repartition("_node").sortWithinPartitions("_node", F.col("_key").bitwiseXOR(F.lit(-(2**63))), "_tie")
    schema = T.StructType([*df.schema.fields, T.StructField("weights", T.ArrayType(T.IntegerType()))])
    return ordered.select(*[F.col(f"`{c}`") for c in df.columns], "_key", "_tie", "_node").mapInArrow(each, schema)


def _by_node(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.Table]]:
    """(node, rows) of rows that come in order of their nodes."""
    held: list[pa.RecordBatch] = []
    node = None
    for batch in batches:
        nodes = batch.column(at).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        for start, stop in zip(edges, edges[1:]):
            if stop == start:
                continue
            if held and nodes[start] != node:
                yield node, pa.Table.from_batches(held)
                held = []
            node = int(nodes[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield node, pa.Table.from_batches(held)


def weighted_sums(df: DataFrame, cols: Sequence[str], replicates: int) -> DataFrame:
    """(replicate, n, …): draws and weighted sums of number columns by replicate. A task adds its rows to one matrix
    and sends one row a replicate; missing values add nothing."""
    values = F.array(F.lit(1.0), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])
    narrow, width = df.select(values.alias("x"), "weights"), len(cols) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            x, w = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (0, 1))
            total += w.T.astype(float) @ x
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"replicate": np.arange(1, replicates + 1), **{f"s{i}": t for i, t in enumerate(total.T)}}), preserve_index=False)

    schema = ", ".join(["replicate long", *[f"s{i} double" for i in range(len(cols) + 1)]])
    sums = narrow.mapInArrow(each, schema).groupBy("replicate").agg(F.sum("s0").cast("long").alias("n"), *[F.sum(f"s{i + 1}").alias(c) for i, c in enumerate(cols)])
    # Replicates of an empty table have no draws, and their sums are 0.
    every = df.sparkSession.range(1).select(replicate_ids(1, replicates).alias("replicate"))
    return every.join(sums, "replicate", "left").select("replicate", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in ("n", *cols)])
