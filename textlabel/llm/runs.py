"""Periodic runs of words by a suffix automaton whose link tree is a link-cut tree.

Each appended word makes the path from its state to the root the most recently seen one. Access cuts that path into
segments of one colour, the place where their words ended last. A segment whose deepest state has length L and last
ended d words earlier says that the L words before both places agree; L >= d makes that a square of period d, with
L + d words as far as it goes to the left. The nearest earlier end is taken, so d is the smallest period. A square is
followed from word to word until it breaks, which gives the whole run.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textlabel.llm.names import column, fresh

Run = tuple[int, int, int]  # start, length, period


def repetitions(codes: Sequence[int]) -> Iterator[Run]:
    """All maximal repetitions with two periods or more, by end. O(n log n) time, some 80 bytes a word."""
    size = 2 * len(codes) + 2
    zeros = bytes(4 * size)
    length, link, word, target = (array("i", zeros) for _ in range(4))
    left, right, parent, last = (array("i", zeros) for _ in range(4))
    more: dict[int, dict[int, int]] = {}  # moves beyond a state's first

    def move(state: int, code: int) -> int:
        if word[state] == code and target[state]:
            return target[state]
        others = more.get(state)
        return others.get(code, 0) if others else 0

    def set_move(state: int, code: int, to: int) -> None:
        if not target[state] or word[state] == code:
            word[state], target[state] = code, to
        else:
            more.setdefault(state, {})[code] = to

    def rotate(x: int) -> None:
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b:
            parent[b] = p
        parent[p], parent[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:  # the colour of a segment stands at the root of its tree
            last[x] = last[p]

    def splay(x: int) -> None:
        while True:
            p = parent[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = parent[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[p] == x) == (left[g] == p) else x)
            rotate(x)

    states = tail = 1
    active: dict[int, int] = {}
    for r, code in enumerate(codes):
        states += 1
        now = states
        length[now] = r + 1
        p = tail
        while p and not move(p, code):
            set_move(p, code, now)
            p = link[p]
        up = 1
        if p:
            up = q = move(p, code)
            if length[q] != length[p] + 1:
                states += 1
                up = states
                length[up], link[up] = length[p] + 1, link[q]
                word[up], target[up] = word[q], target[q]
                if q in more:
                    more[up] = dict(more[q])
                # Its words ended last where those of q did: it joins the segment of q, just above q.
                splay(q)
                x = left[q]
                left[up], left[q], parent[up] = x, up, q
                if x:
                    parent[x] = up
                link[q] = up
                while p and move(p, code) == q:
                    set_move(p, code, up)
                    p = link[p]
        link[now] = parent[now] = up
        tail = now
        seen: dict[int, int] = {}
        low, y = now, up
        while y:  # access: one step a segment
            splay(y)
            d = r - last[y]
            if d <= length[y]:
                seen[d] = r - length[y] - d + 1
            x = right[y]
            if x:
                last[x] = last[y]
            right[y] = low
            low, y = y, parent[y]
        last[low] = r
        for d, start in active.items():
            if seen.get(d) != start:
                yield start, r - start, d
        active = seen
    for d, start in active.items():
        yield start, len(codes) - start, d


def stretches(codes: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(begin, first, end) of the parts that can hold a run that ends in words first to end - 1.

    In a run of period q every word after the first q was last seen at most q words before, and there are at least
    (min_exponent - 1) q of them. So in an unbroken stretch of S such words no distance above S / (min_exponent - 1)
    counts; words with larger ones break it, until nothing changes. No run is lost.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    distance = np.full(n, n + 1, np.int64)
    again = codes[order[1:]] == codes[order[:-1]]
    distance[order[1:][again]] = (order[1:] - order[:-1])[again]
    folds = min_exponent - 1
    # The fewest words after the first period that any run has.
    fewest = min(max(min_length, min_exponent * q) - q for q in range(1, max(2, -(-min_length // min_exponent)) + 1))
    good = distance <= n // min_exponent
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        first, end = edges[::2], edges[1::2]
        sizes = end - first
        keep = sizes >= fewest
        first, end, sizes = first[keep], end[keep], sizes[keep]
        if not len(first):
            return []
        most = np.zeros(n, np.int64)
        for a, b, s in zip(first, end, sizes // folds):
            most[a:b] = s
        closer = distance <= most
        if np.array_equal(closer, good):
            break
        good = closer
    return [(max(0, a - s // folds), a, b) for a, b, s in zip(first.tolist(), end.tolist(), sizes.tolist())]


def find_runs(words: Sequence[bytes], min_length: int = 6, min_exponent: int = 4) -> list[Run]:
    """Runs of a word sequence by start, then period: maximal stretches whose smallest period q repeats, with at least
    `min_length` and `min_exponent` q words. `min_exponent` is a whole number of 2 or more."""
    if min_exponent < 2:
        raise ValueError("squares are found: min_exponent must be 2 or more")
    known: dict[bytes, int] = {}
    codes = np.fromiter(map(known.setdefault, words, range(len(words))), np.int64, len(words))
    if len(known) == len(words) or len(words) < max(min_length, min_exponent):
        return []
    out = []
    for begin, first, end in stretches(codes, min_length, min_exponent):
        for start, length, period in repetitions(codes[begin:end].tolist()):
            start += begin
            if length >= max(min_length, min_exponent * period) and start + length > first:
                out.append((start, length, period))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


def collapse(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """`words` without those that any run contains after its first period."""
    if not runs:
        return list(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(
    docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4, runs_col: str = "runs",
    collapsed_col: str = "collapsed", words_col: str = "n_words",
) -> DataFrame:
    """`docs` without its text, with the number of words, the runs (array of start, length, period; words counted from
    0; by start, then period) and the collapsed text, which keeps one period of each run, joined by single blanks.

    Words are what ASCII blanks and line breaks separate; letter case counts. Row by row: no shuffle, and no text needs
    another. NULL is read as the empty text: no words, no runs, an empty collapsed text. Repeated rows stay, other
    columns pass through, an empty table gives an empty result. New names that meet a column get an underscore.

    A task holds one Arrow batch of texts and the words of one text at a time. Only stretches that can hold a run go
    through the automaton; a text that is one run from end to end does so whole, with some 80 bytes a word.
    """
    others = [c for c in docs.columns if c != text_col]
    names = []
    for c in (words_col, runs_col, collapsed_col):
        name = c
        while name.lower() in {x.lower() for x in [*docs.columns, *names]}:
            name += "_"
        names.append(name)
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    new = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), run_type, T.StringType()))]
    schema = T.StructType([*[docs.schema[c] for c in others], *new])
    arrow_run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column(len(others)):
                words = (text.as_py() or "").encode().split()
                runs = find_runs(words, min_length, min_exponent)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(collapse(words, runs)).decode())
            made = [pa.array(counts, pa.int64()), pa.array(found, arrow_run), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=[*others, *names])

    return docs.select(*[column(c) for c in others], column(text_col)).mapInArrow(each, schema)
