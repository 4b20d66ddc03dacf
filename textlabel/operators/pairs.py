"""Co-occurrence counts of many columns or words: frequent ones as dense blocks, the others as packed pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.session import settle

# The dense block of so many columns takes 2 MB in each task.
FREQUENT = 512
ROWS_AT_ONCE = 1024
# Packed pairs are counted when so many are held, and long rows are paired in pieces of that size: 32 MB.
PAIRS_HELD = 1 << 22
# Short rows give small arrays: so many are put together to one, which takes less room than they do.
ARRAYS_HELD = 1 << 12


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    """Empties `held`."""
    pairs = np.concatenate(held)
    held.clear()
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
    n = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    return _batch((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n)


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _pieces(rare: np.ndarray, all_items: np.ndarray, place: dict[int, int]) -> Iterator[np.ndarray]:
    """Packed pairs (smaller, larger) of a row with a rare item in them, each once, in pieces of bounded size."""
    frequent = all_items[~np.isin(all_items, rare)] if place else all_items[:0]
    step = max(1, PAIRS_HELD // max(1, len(all_items)))
    for start in range(0, len(rare), step):
        part = rare[start : start + step]
        low, high = np.triu_indices(len(part))  # within the piece, an item with itself as well
        yield (part[low] << 32) | part[high]
        for other in (rare[start + step :], frequent):
            x, y = np.repeat(part, len(other)), np.tile(other, len(part))
            yield (np.minimum(x, y) << 32) | np.maximum(x, y)


def counter(top: list[int]):
    """Counts the pairs of a task's rows; `top` are the frequent items, in order."""
    place = {item: k for k, item in enumerate(top)}
    known = np.array(top, np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((len(known), len(known)))
        held, small, size = [], [], 0
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, ROWS_AT_ONCE):
                lists = whole_batch.slice(start, ROWS_AT_ONCE).column(0)
                length = lists.value_lengths().to_numpy()
                flat = lists.flatten().to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1) if len(known) else np.zeros(len(flat), int)
                dense = known[at] == flat if len(known) else np.zeros(len(flat), bool)
                x = np.zeros((len(length), len(known)), np.float32)
                row = np.repeat(np.arange(len(length)), length)
                x[row[dense], at[dense]] = 1
                block += x.T @ x
                ends = np.cumsum(length)
                for r in np.unique(row[~dense]).tolist():
                    mine = slice(ends[r] - length[r], ends[r])
                    for piece in _pieces(flat[mine][~dense[mine]], flat[mine], place):
                        if not len(piece):
                            continue
                        small.append(piece)
                        size += len(piece)
                        if len(small) >= ARRAYS_HELD or size >= PAIRS_HELD:
                            held.append(np.concatenate(small))
                            small = []
                        if size >= PAIRS_HELD:
                            yield _counted(held)
                            held, size = [], 0
        if small:
            held.append(np.concatenate(small))
        if held:
            yield _counted(held)
        a, b = np.nonzero(np.triu(block))
        if len(a):
            yield _batch(known[a], known[b], block[a, b].astype(np.int64))

    return each


def pair_counts(df: DataFrame, items: str | Column, frequent: int = FREQUENT, min_n: int = 1) -> DataFrame:
    """(a, b, n): in how many rows the items a <= b, numbers from 0 to 2^31 - 1, occur together; (a, a, n) counts a alone.

    `items` is an array of the numbers of a row: the columns that are not zero, or the words of a text. Repeats in a row
    and NULLs count nothing; a row with a NULL or empty array has no pairs. The `frequent` items of the most rows (ties:
    smaller numbers) meet in a matrix product within the task, so a row with very many of them costs no more than its
    length times their number; pairs with a rarer item are counted in the task before they are shuffled. A pair of any row is a
    row of the result, at least `min_n` times; no pair is left out.
    """
    whole = F.array_sort(F.array_distinct(F.array_compact(F.col(items) if isinstance(items, str) else items))).cast("array<int>")
    rows = settle(df.select(whole.alias("i")).filter(F.size("i") > 0), "pair-rows")
    counts = rows.select(F.explode("i").alias("item")).groupBy("item").count()
    top = sorted(r["item"] for r in counts.orderBy(F.desc("count"), "item").limit(frequent).collect())  # `frequent` numbers
    found = rows.mapInArrow(counter(top), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= min_n) if min_n > 1 else found
