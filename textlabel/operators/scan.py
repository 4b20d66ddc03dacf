"""Concept mentions by one pass over each text: the aliases of a lexicon as a trie of words.

A trie of bounded size goes to the tasks as sorted arrays, and all words of a batch walk down it together: a word
where no alias begins falls out at the first step, so the number of alias lengths costs nothing. A lexicon of more
than the bound is split by the first word of its aliases into several tries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textlabel.operators.joins import BROADCAST_BYTES, measured_bytes

# Words that walk at once; what a task holds beside its batch depends on this, unless a single text has more.
WORDS_AT_ONCE = 1 << 18


class Trie:
    """Aliases as sorted arrays. `levels[d]` holds parent * base + word for each node at depth d + 1, whose number
    is its place there; `aliases[d]` holds the place in the list of the alias that ends in the node, or -1."""

    def __init__(self, aliases: list[list[str]]):
        words = sorted({w for alias in aliases for w in alias})
        self.words = pa.array(words, pa.string())
        code = {w: i for i, w in enumerate(words)}
        size = np.array([len(alias) for alias in aliases], np.int64)
        self.depth = int(size.max(initial=0))
        node = np.zeros(len(aliases), np.int64)
        self.base = max(1, len(words))
        self.levels: list[np.ndarray] = []
        self.aliases: list[np.ndarray] = []
        for step in range(self.depth):
            alive = np.flatnonzero(size > step)
            word = np.fromiter((code[aliases[i][step]] for i in alive), np.int64, len(alive))
            level, place = np.unique(node[alive] * self.base + word, return_inverse=True)
            node[alive] = place  # nodes are numbered within their level
            alias = np.full(len(level), -1, np.int64)
            done = size[alive] == step + 1
            alias[place[done]] = alive[done]
            self.levels.append(level)
            self.aliases.append(alias)

    def walk(self, codes: np.ndarray, room: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, alias) of all aliases that begin at the given places; `room` words are left in the text there."""
        at = starts[codes[starts] >= 0]
        node, found = np.zeros(len(at), np.int64), []
        for step, (level, alias) in enumerate(zip(self.levels, self.aliases)):
            fits = room[at] > step
            at, node = at[fits], node[fits]
            code = codes[at + step]
            key = node * self.base + code
            spot = np.minimum(np.searchsorted(level, key), len(level) - 1)
            down = (code >= 0) & (level[spot] == key)
            at, node = at[down], spot[down]
            if not len(at):
                break
            named = alias[node] >= 0
            found.append((at[named], np.full(named.sum(), step + 1), alias[node[named]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(part) for part in zip(*found))


def leftmost_longest(text: np.ndarray, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the matches stay when each text is read from the left and the longest match at a place is taken."""
    order = np.lexsort((-length, pos, text))
    keep, last, free = [], -1, 0
    for i, t, p, n in zip(order.tolist(), text[order].tolist(), pos[order].tolist(), length[order].tolist()):
        if t != last:
            last, free = t, 0
        if p >= free:
            keep.append(i)
            free = p + n
    return np.sort(np.array(keep, np.int64))


def pieces(batch: pa.RecordBatch, words: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows of a batch (id, words) in order, so many that they hold some `words`; a longer text is a piece of its own."""
    total = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + words, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _scan(trie: Trie, names: pa.Array, longest: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            lists = batch.column(1)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # One number for each word of the batch; -1 where the lexicon has no such word.
            codes = lists.flatten().dictionary_encode()
            number = pc.index_in(codes.dictionary, trie.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = number[codes.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
            text = np.repeat(np.arange(len(count)), count)
            first = np.cumsum(count) - count
            room = first[text] + count[text] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
            parts = [
                trie.walk(flat, room, np.arange(i, min(i + WORDS_AT_ONCE, len(flat)))) for i in range(0, len(flat), WORDS_AT_ONCE)
            ] or [(np.zeros(0, np.int64),) * 3]
            start, length, alias = (np.concatenate(p) for p in zip(*parts))
            owner = text[start] if len(start) else start
            pos = start - first[owner] if len(start) else start
            if longest:
                stay = leftmost_longest(owner, pos, length)
                owner, pos, length, alias = owner[stay], pos[stay], length[stay], alias[stay]
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(pos, pa.int64()), pa.array(length.astype(np.int32)), names.take(pa.array(alias, pa.int64()))],
                names=["id", "pos", "n_words", "alias"],
            )

    return each


def _resolve(found: DataFrame) -> DataFrame:
    """Leftmost-longest among the matches of several tries, by a fold over the matches of each text in order."""
    spots = F.array_sort(F.collect_list(F.struct("pos", (-F.col("n_words")).alias("less"), "alias")))
    one = T.StructType([T.StructField("pos", T.LongType()), T.StructField("less", T.IntegerType()), found.schema["alias"]])
    start = F.struct(F.lit(0).cast("long").alias("free"), F.array().cast(T.ArrayType(one)).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        taken = F.struct((m["pos"] - m["less"]).cast("long").alias("free"), F.concat(acc["out"], F.array(m)).alias("out"))
        return F.when(m["pos"] >= acc["free"], taken).otherwise(acc)

    kept = found.groupBy("id").agg(F.aggregate(spots, start, step, lambda acc: acc["out"]).alias("m"))
    return kept.select("id", F.explode("m").alias("m")).select("id", "m.pos", (-F.col("m.less")).alias("n_words"), "m.alias")


def scan_aliases(
    words: DataFrame, aliases: DataFrame, overlaps: str = "all", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(id, pos, n_words, alias): where the word lists of `aliases` (alias, words) stand in those of `words` (id, words).

    `pos` counts words from 0. With `overlaps="all"` every place counts; with "longest" each text is read from the left, the
    longest alias at a place is taken, and the next one may begin behind it. Aliases of more than `max_bytes` (measured)
    are split by their first word, and the texts are scanned once for each part; the matches of the parts then meet by text. Of aliases
    with equal words one is reported. NULL and empty texts and aliases match nothing; rows with equal ids are scanned one by one with
    a single trie, and count as one text where "longest" must bring parts together.
    """
    if overlaps not in ("all", "longest"):
        raise ValueError("overlaps must be 'all' or 'longest'")
    known = aliases.filter(F.size("words") > 0).select("alias", "words")
    parts = max(1, -(-measured_bytes(known) // max_bytes))
    schema = T.StructType(
        [
            T.StructField("id", words.schema["id"].dataType),
            T.StructField("pos", T.LongType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("alias", known.schema["alias"].dataType),
        ]
    )
    out = None
    for part in range(parts):
        mine = F.pmod(F.xxhash64(F.element_at("words", 1)), F.lit(parts)) == part
        held = known.filter(mine).collect()
        names = pa.array([r["alias"] for r in held], to_arrow_type(known.schema["alias"].dataType))
        scan = _scan(Trie([r["words"] for r in held]), names, overlaps == "longest" and parts == 1)
        found = words.select("id", "words").mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return _resolve(out) if overlaps == "longest" and parts > 1 else out
