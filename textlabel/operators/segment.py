"""Words in scripts that put no blanks between them: a unigram lexicon learned from the corpus, and the best path through it.

Every substring of a run of such letters is a possible word. Candidates are counted over the whole corpus, their
shares are refined by cutting all runs along their best paths and counting what was used, and a text is cut along
the path of the greatest likelihood (Viterbi). Distinct runs are cut once, however often they stand in the corpus.
Tasks count and cut whole batches: a longer substring is only counted where the shorter ones in it are frequent enough
for it to get into the lexicon, and the paths of runs of similar length are found side by side.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabel.operators import joins
from textlabel.session import settle

# Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = r"[฀-໿က-႟ក-៿ぁ-ヿ㐀-䶿一-鿿豈-﫿]+"
# The most words a lexicon keeps: it travels to the tasks.
MAX_WORDS = 100_000
# Lengths of substrings that are counted first, and then by so many at a time.
FIRST, STEP = 4, 2
# A task hands on its counts when it holds so many words.
HELD = 500_000
# Bits (as a power of 2) of the filter that says which substrings are frequent, and the tasks that fill it.
FILTER_BITS, FILTER_TASKS = 25, 8
# Letters of the runs whose paths are found side by side, and the fewest runs for which that pays.
SIDE_BY_SIDE, FEWEST = 1 << 18, 24


def letter_runs(df: DataFrame, text: str = "text", pattern: str = UNSPACED) -> DataFrame:
    """(run, n): the distinct runs of the pattern's letters and how often each occurs."""
    found = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(pattern), F.lit(0)))
    return df.select(found.alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def best_path(run: str, costs: Mapping[str, float], max_len: int, unknown: float) -> list[str]:
    """The words of least total cost that make up the run. A letter that is no word costs `unknown`; of equal paths the one with
    fewer words is taken, then the one whose last word is longer."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    back = [0]
    for end in range(1, len(run) + 1):
        top, start = (math.inf, 0), end - 1
        for begin in range(max(0, end - max_len), end):
            cost = costs.get(run[begin:end], unknown if end - begin == 1 else None)
            if cost is None:
                continue
            total = (round(best[begin][0] + cost, 9), best[begin][1] + 1)
            if total < top:
                top, start = total, begin
        best.append(top)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def _slots(codes: np.ndarray, length: int) -> np.ndarray:
    """The filter's slot of every stretch of `length` code points."""
    h = np.zeros(max(0, len(codes) - length + 1), dtype=np.uint64)
    for k in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _frequent(words: DataFrame, length: int) -> np.ndarray:
    """Packed bits of the slots of the `words` (word), all of one length: none of them is missing, some others may be there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            codes = _codes("".join(batch.column(0).to_pylist()))
            bits[_slots(codes, length)[::length]] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in words.coalesce(FILTER_TASKS).mapInArrow(each, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _substrings(lengths: Sequence[int], shared=None):
    """Counts of a task's substrings (word, n) of the given lengths; with a filter of the substrings of one letter less than
    the first of them, only those that consist of such."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.unpackbits(shared.value).view(bool)
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bits is not None:
                    ok = bits[_slots(_codes(run), lengths[0] - 1)]
                for k in lengths:
                    if bits is None:
                        found = [run[i : i + k] for i in range(len(run) - k + 1)]
                    else:
                        ok = ok[:-1] & ok[1:]
                        found = [run[i : i + k] for i in np.flatnonzero(ok).tolist()]
                    if n == 1:
                        held.update(found)
                    else:
                        for word in found:
                            held[word] += n
                    if len(held) > HELD:
                        yield hand_on()
        yield hand_on()

    return each


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


def _look_up(wanted: np.ndarray, starts: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of the wanted keys in a table grouped by bucket; 0 where there is none."""
    out = np.zeros(len(wanted), dtype=np.int64)
    bucket = _bucket(wanted, len(starts) - 1)
    at, end = starts[bucket], starts[bucket + 1]
    open_ = np.flatnonzero(at < end)
    at, end, wanted = at[open_], end[open_], wanted[open_]
    while len(open_):
        same = keys[at] == wanted
        out[open_[same]] = values[at[same]]
        more = ~same & (at + 1 < end)
        open_, at, end, wanted = open_[more], at[more] + 1, end[more], wanted[more]
    return out


class Lexicon:
    """Words with their costs, the negative logarithms of their shares."""

    def __init__(self, counts: Mapping[str, float]):
        total = sum(counts.values()) or 1.0
        self.costs = {w: -math.log(n / total) for w, n in counts.items() if n > 0}
        self.max_len = max(map(len, self.costs), default=1)
        # A letter never seen alone is dearer than the rarest word.
        self.unknown = max(self.costs.values(), default=0.0) + 10.0

    def cut(self, run: str | None) -> list[str]:
        return best_path(run or "", self.costs, self.max_len, self.unknown)

    @cached_property
    def _trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(letters, bucket starts, keys by bucket, child nodes, costs by node). A key is node x (letters + 1) + letter number from 1;
        node 0 is the root, and a node that is no word costs infinity."""
        letters = sorted({ord(c) for w in self.costs for c in w})
        number, base = {chr(c): i + 1 for i, c in enumerate(letters)}, len(letters) + 1
        children: dict[int, int] = {}
        cost = [math.inf]
        for word, c in self.costs.items():
            node = 0
            for letter in word:
                key = node * base + number[letter]
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(cost)
                    cost.append(math.inf)
            cost[node] = c
        keys, nodes = np.array(list(children), dtype=np.int64), np.array(list(children.values()), dtype=np.int64)
        bucket = _bucket(keys, n := 1 << max(1, (2 * len(keys)).bit_length()))
        order = np.argsort(bucket, kind="stable")
        starts = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.bincount(bucket, minlength=n), out=starts[1:])
        return np.array(letters, dtype=np.int64), starts, keys[order], nodes[order], np.array(cost)

    def _word_costs(self, letters: np.ndarray) -> np.ndarray:
        """(end, word length from the longest down to 1, run): costs of the words that end at each place of the runs, whose
        letters stand in columns, with -1 after their ends."""
        known, starts, keys, nodes, cost = self._trie
        steps, runs = letters.shape
        out = np.full((steps, self.max_len, runs), math.inf)
        out[:, -1][letters >= 0] = self.unknown
        if not len(known):
            return out
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        number = np.where(known[at] == letters, at + 1, 0)
        row, col = np.nonzero(number)
        node = np.zeros(len(row), dtype=np.int64)
        for k in range(min(self.max_len, steps)):
            inside = row + k < steps
            row, col, node = row[inside], col[inside], node[inside]
            child = _look_up(node * (len(known) + 1) + number[row + k, col], starts, keys, nodes)
            row, col, node = row[child > 0], col[child > 0], child[child > 0]
            word = np.isfinite(cost[node])
            out[row[word] + k, self.max_len - 1 - k, col[word]] = cost[node[word]]
        return out

    def _paths(self, runs: list[str]) -> list[list[str]]:
        """`cut` of runs of similar length, longest first, side by side."""
        steps, long = len(runs[0]), self.max_len
        letters = np.full((steps, len(runs)), -1, dtype=np.int64)
        for i, run in enumerate(runs):
            letters[: len(run), i] = _codes(run)
        costs = self._word_costs(letters)
        best, words = np.full((long + steps, len(runs)), math.inf), np.zeros((long + steps, len(runs)), dtype=np.int64)
        best[long - 1] = 0.0
        back = np.empty((steps, len(runs)), dtype=np.int64)
        # Totals this close to half of the last decimal are rounded one by one, as the product may be off by so much.
        doubt = max(1e-3, 4 * float(np.spacing(steps * self.unknown * 1e9)))
        pick = np.arange(len(runs))
        with np.errstate(invalid="ignore"):
            for t in range(steps):
                total = best[t : t + long] + costs[t]
                scaled = total * 1e9
                whole = np.rint(scaled)
                unsure = np.abs(np.abs(scaled - whole) - 0.5) < doubt
                rounded = whole / 1e9
                if unsure.any():
                    rounded[unsure] = [round(x, 9) for x in total[unsure].tolist()]
                least = rounded.min(axis=0)
                count = np.where(rounded == least, words[t : t + long], np.iinfo(np.int64).max - 1)
                first = count.argmin(axis=0)
                best[t + long], words[t + long], back[t] = least, count[first, pick] + 1, long - first
        out = []
        for run, lengths in zip(runs, back.T.tolist()):
            path, end = [], len(run)
            while end:
                begin = end - lengths[end - 1]
                path.append(run[begin:end])
                end = begin
            out.append(path[::-1])
        return out

    def cut_all(self, runs: Sequence[str | None]) -> list[list[str]]:
        """`cut` of every run."""
        out: list[list[str]] = [[] for _ in runs]
        order = sorted((i for i, run in enumerate(runs) if run), key=lambda i: -len(runs[i]))
        while order:
            steps = len(runs[order[0]])
            n = max(1, SIDE_BY_SIDE // (steps * self.max_len) * 4)
            mine, order = order[:n], order[n:]
            few = len(mine) < FEWEST or steps * self.unknown * 1e9 >= 2**50
            for i, path in zip(mine, map(self.cut, [runs[i] for i in mine]) if few else self._paths([runs[i] for i in mine])):
                out[i] = path
        return out

    @classmethod
    def learn(
        cls, runs: DataFrame, max_len: int = 6, min_count: int = 5, max_words: int = MAX_WORDS, rounds: int = 4
    ) -> Lexicon:
        """A lexicon from the counted `runs` (run, n) of a whole corpus.

        Candidates are all substrings of up to `max_len` letters with `min_count` or more occurrences (single letters always), at most the
        `max_words` with the most letters in them overall, ties by word. In each round all runs are cut along their best paths, and a word
        is kept with the number of times it was used; single letters keep at least one. An empty corpus gives an empty lexicon.
        """
        tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # A run costs time by its letters in every round, so that even a small table is worth sharing out.
        known = settle(runs.filter("run <> ''").repartition(tasks, "run"), "distinct-runs")
        enough = (F.col("n") >= min_count) | (F.length("word") == 1)
        weight = F.col("n") * F.length("word")
        counted, shared, length = [], None, 0
        while length < max_len:
            lengths = list(range(length + 1, min(max_len, length + STEP if length else FIRST) + 1))
            parts = known.select("run", "n").mapInArrow(_substrings(lengths, shared), "word string, n long")
            counted.append(settle(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(enough), "substrings"))
            kept, length = joins.union_all(counted), lengths[-1]
            if length < max_len:
                # A word whose weight is below that of the last of `max_words` others is out, and so is a longer one that holds a rarer one.
                last = kept.select(weight.alias("w")).orderBy(F.desc("w")).limit(max_words).agg(F.count("w").alias("n"), F.min("w").alias("w")).first()
                least = last["w"] if last["n"] == max_words else 0
                frequent = counted[-1].filter((F.length("word") == length) & (F.col("n") >= min_count) & (F.col("n") * max_len >= (least or 0)))
                shared = runs.sparkSession.sparkContext.broadcast(_frequent(frequent.select("word"), length))
        top = kept.orderBy(F.desc(weight), "word").limit(max_words)
        counts = {r["word"]: float(r["n"]) for r in top.collect()}
        for _ in range(rounds):
            used = cls(counts).cut_runs(known).select(F.explode("words").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
            letters = {w: 1.0 for w in counts if len(w) == 1}
            # Only words of the lexicon before and letters that the cut left out of it can be used, so this is bounded too.
            counts = letters | {r["word"]: float(r["n"]) for r in used.collect()}
        return cls(counts)

    def cut_runs(self, runs: DataFrame) -> DataFrame:
        """`runs` with an array column `words`."""
        shared = runs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = shared.value
            for batch in batches:
                yield pd.Series(lexicon.cut_all(batch.tolist()), dtype=object)

        return runs.withColumn("words", cut("run"))

    def segment(self, df: DataFrame, id_col: str = "id", text: str = "text", pattern: str = UNSPACED) -> DataFrame:
        """(id, words): the words of each text's runs in order; NULL and texts without a run have an empty list. Rows stay where they are."""
        found = F.coalesce(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = shared.value
            for batch in batches:
                ends = np.cumsum([0, *map(len, batch)])
                paths = lexicon.cut_all([run for runs in batch for run in runs])
                yield pd.Series([[w for path in paths[a:b] for w in path] for a, b in zip(ends, ends[1:])], dtype=object)

        return df.select(F.col(f"`{id_col}`"), cut(found).alias("words"))
