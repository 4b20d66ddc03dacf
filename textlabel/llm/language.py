"""Language by n-gram filters: a Bloom filter whose slots hold one bit for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.session import settle

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_BATCH_CHARS = 1 << 21
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of all texts, words set apart by single blanks, and where each text begins."""
    clean = [f" {_NOT_LETTERS.sub(' ', t.lower()).strip()} " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in clean])])
    return np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.uint64), starts


def grams(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams (n at most 3) of the texts as exact numbers, with the index of their text; none crosses texts."""
    codes, starts = _codes(texts)
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = codes[:count].copy()
    for i in range(1, n):
        out = (out << np.uint64(21)) | codes[i : count + i]
    at = np.searchsorted(starts, np.arange(count), "right") - 1
    inside = np.arange(count) + n <= starts[at + 1]
    return out[inside], at[inside]


def _slots(gram: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
    out = []
    for k in range(hashes):
        x = gram * _MIX[k] ^ (gram >> np.uint64(29)) * _MIX[(k + 1) % 4]
        x ^= x >> np.uint64(32)
        out.append((x * _MIX[(k + 2) % 4]) >> np.uint64(64 - bits))
    return out


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # one unsigned number per slot, bit i for languages[i]
    hashes: int
    n: int

    @property
    def bits(self) -> int:
        return int(len(self.slots)).bit_length() - 1

    def false_rates(self) -> np.ndarray:
        """Per language the chance that a gram it lacks is found all the same."""
        fill = [np.count_nonzero(self.slots >> np.uint64(i) & np.uint64(1)) / len(self.slots) for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) grams found, and grams of each text."""
        gram, at = grams(texts, self.n)
        mask = np.full(len(gram), ~np.uint64(0))
        for slot in _slots(gram, self.hashes, self.bits):
            mask &= self.slots[slot]
        found = [
            np.bincount(at, weights=(mask >> np.uint64(i) & np.uint64(1)).astype(np.float64), minlength=len(texts))
            for i in range(len(self.languages))
        ]
        return np.stack(found, 1) if found else np.zeros((len(texts), 0)), np.bincount(at, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: false positives taken out, the language with most grams wins (the first by name
        among equals), and the score is its share of what all languages have."""
        found, total = self.hits([t or "" for t in texts])
        rate = self.false_rates()
        true = np.clip((found - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0, None)
        known = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = true.argmax(1)
        share = np.where(true.sum(1) > 0, true[np.arange(len(texts)), best] / np.maximum(true.sum(1), 1e-9), 1 / len(self.languages))
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, share, 0.0)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece holds about two million characters (or one text)."""
    for batch in batches:
        sizes = np.cumsum([len(t.as_py() or "") for t in batch.column(1)])
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + _BATCH_CHARS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def fit(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    n: int = 3,
    least_rate: float = 1e-5,
    bits: int = 20,
    hashes: int = 3,
) -> LanguageFilter:
    """Learn the n-grams of each language from all rows with a language and a text.

    A language has an n-gram if it makes up at least `least_rate` of the language's n-grams (so a language has at most
    1 / least_rate of them, however large the corpus). A gram carries the bits of all languages that have it.
    Counts cover all rows and are summed within tasks before the shuffle. Slot masks are joined by OR; at most 2**bits of
    them (one million numbers) come to the driver. At most 64 languages. No rows: a filter without languages.
    """
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            gram, number = totals.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(number)], names=["lang", "gram", "n"]
            )

        for batch in _chunks(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                gram, number = np.unique(grams([t for t, x in zip(texts, langs) if x == lang], n)[0], return_counts=True)
                if lang in totals:
                    gram, place = np.unique(np.concatenate([totals[lang][0], gram]), return_inverse=True)
                    number = np.bincount(place, weights=np.concatenate([totals[lang][1], number])).astype(np.int64)
                totals[lang] = gram, number.astype(np.int64)
                if len(gram) > 1 << 20:
                    yield out(lang)
        for lang in list(totals):
            yield out(lang)

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = settle(counts, "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.limit(65).collect())
    if len(languages) > 64:
        raise ValueError("more than 64 languages")
    if not languages:
        return LanguageFilter([], np.zeros(1 << bits, np.uint64), hashes, n)
    # At most 64 rows.
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.filter(F.col("rate") >= least_rate).groupBy("gram").agg(F.collect_list("lang").alias("each"))
    bit = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    mask = F.aggregate(
        "each",
        F.lit(0).cast("long"),
        lambda acc, e: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit[e])),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, masks = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            slots = np.concatenate(_slots(gram, hashes, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.tile(masks, hashes))], names=["slot", "mask"])

    placed = top.select("gram", mask.alias("mask")).mapInArrow(place, "slot long, mask long")
    merged = placed.groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    slots = np.zeros(1 << bits, np.uint64)
    table = merged.toArrow()  # at most 2**bits rows
    slots[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return LanguageFilter(languages, slots, hashes, n)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score): row-local; only the id and text columns are read.

    NULL texts, empty texts and texts without a letter are `und` with score 0; a text none of whose n-grams is
    known gets the first language with an even share. Repeated rows and NULL ids are predicted like others."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            names, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"]
            )

    schema = T.StructType([narrow.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(each, schema).withColumnRenamed("id", id_col)
