"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.llm.components import connected_components
from textlabel.llm.names import column, fresh
from textlabel.session import settle

_WORD = re.compile(r"\S+")
# Words of the stretches: scripts without blanks count each character as one.
_BARE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_BARE}]|[^\s{_BARE}]+")
_FIRST_BARE = "\u0e00"
# A line of more words than this is cut at some of its sentence ends.
LONG_LINE = 80
# Two documents that share so many words in a row share a stretch.
STRETCH = 50
# Joins the words of a stretch. It is white space, so no word holds it.
_GLUE = "\x1f"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WINDOWS_AT_ONCE = 1 << 14
_SHINGLES_AT_ONCE = 1 << 14


def tune_bands(threshold: float, recall: float = 0.999, most: int = 256) -> tuple[int, int]:
    """(rows, bands): the most rows a band, so the fewest chance collisions, with which a pair at `threshold` collides with
    probability `recall`, using at most 32 permutations where that is possible, `most` otherwise."""
    for limit in (32, most):
        for rows in range(limit, 0, -1):
            bands = limit // rows
            if bands and 1 - (1 - threshold**rows) ** bands >= recall:
                while bands > 1 and 1 - (1 - threshold**rows) ** (bands - 1) >= recall:
                    bands -= 1
                return rows, bands
    raise ValueError("no banding reaches this recall")


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One mixed number for each `width` neighbours in a row."""
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out = out * _MULT + hashes[i : i + len(out)]
    out = (out ^ (out >> np.uint64(29))) * _MULT
    return out ^ (out >> np.uint64(32))


def _lowered(text: str, words: list[str]) -> list[str]:
    """The words in lower case; the whole text at once where no letter changes its length or depends on its neighbours."""
    low = text.lower()
    if len(low) == len(text) and "\u03a3" not in text:
        found = low.split()
        if len(found) == len(words):
            return found
    return [w.lower() for w in words]


def _placed(text: str, words: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words, which are all matches of the pattern."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    before = np.ones(len(words), np.int64)
    if not words or len(text) != size.sum() + len(words) - 1 or text[:1].isspace() or text[-1:].isspace():
        before = np.fromiter(map(len, pattern.split(text)[:-1]), np.int64, len(words))
    elif words:
        before[0] = 0
    ends = np.cumsum(size + before)
    return ends - size, ends


def lines(text: str, min_words: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each line of at least `min_words` words.

    Lines of more than LONG_LINE words are cut after sentence ends, at those that a hash of the two words before chooses (every
    second one): the same passage within two long lines is so cut at the same places, whatever stands around it."""
    out, at = [], 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        plain = line.split()
        if len(plain) < min_words:
            continue
        words = _lowered(line, plain)
        if len(words) <= LONG_LINE:
            out.append((begin, begin + len(line), words))
            continue
        starts, ends = _placed(line, plain, _WORD)
        first = 0
        for i in [i for i, w in enumerate(words) if w[-1] in ".!?" or i == len(words) - 1]:
            if i < len(words) - 1 and not (i and xxhash.xxh32_intdigest(f"{words[i - 1]} {words[i]}") % 2 == 0):
                continue
            if i + 1 - first >= min_words:
                out.append((begin + int(starts[first]), begin + int(ends[i]), words[first : i + 1]))
            first = i + 1
    return out


def _chosen(grams: np.ndarray, reach: int) -> list[int]:
    """Places such that each `reach` neighbours in a row have one with their smallest value, by values alone.

    Of equal values the last counts, and none is added for windows that a chosen equal one lies in, so a text that repeats one word
    has one place in `reach`."""
    views = np.lib.stride_tricks.sliding_window_view(grams, reach)[:, ::-1]
    parts = [views[i : i + _WINDOWS_AT_ONCE].argmin(1) for i in range(0, len(views), _WINDOWS_AT_ONCE)]
    last = np.arange(len(views)) + (reach - 1) - np.concatenate(parts)
    spots, first = np.unique(last, return_index=True)
    until = np.append(first[1:], len(views)) - 1
    out: list[int] = []
    for spot, end in zip(spots.tolist(), until.tolist()):
        if not (out and out[-1] >= end and grams[out[-1]] == grams[spot]):
            out.append(spot)
    return out


def stretches(text: str, min_words: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, [lower-case words as one]) of runs of `min_words` words, wherever lines and sentences end.

    Runs are chosen by the smallest hash among neighbours (winnowing), so that any STRETCH words (twice `min_words` if that is more)
    that stand in two documents hold a run that is chosen in both. As the words are given as one, only equal runs are
    similar. `start` is the end of the word before: cutting takes the blank along, and no line starts there. The first
    word of a text has none before it, so the first run is left out of the choice; the bound above allows for that."""
    blanks_only = text.isascii() or max(text, default="") < _FIRST_BARE
    tokens = text.split() if blanks_only else _TOKEN.findall(text)
    reach = max(STRETCH, 2 * min_words) - min_words
    if len(tokens) - min_words + 1 <= reach:
        return []
    words = _lowered(text, tokens) if blanks_only else [w.lower() for w in tokens]
    starts, ends = _placed(text, tokens, _WORD if blanks_only else _TOKEN)
    grams = _rolled(_hashes(words), min_words)
    chosen = [i + 1 for i in _chosen(grams[1:], reach)]
    return [(int(ends[i - 1]), int(ends[i + min_words - 1]), [_GLUE.join(words[i : i + min_words])]) for i in chosen]


def paragraphs(text: str, min_words: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of all units that are compared: `lines` and `stretches`."""
    return lines(text, min_words) + stretches(text, min_words)


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _units(min_words: int, with_text: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, end, count, digest, body = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                # Stretches match as a whole, by their digests: their words are not needed again.
                for a, b, words in (lines if with_text else paragraphs)(text or "", min_words):
                    plain = " ".join(words)
                    digest.append(xxhash.xxh3_128_digest(plain))
                    if with_text:
                        body.append(plain)
                        continue
                    rows.append(i)
                    start.append(a)
                    end.append(b)
                    count.append(len(words) if len(words) > 1 else plain.count(_GLUE) + 1)
            if with_text:
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(body, pa.string())], names=["digest", "text"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(start, pa.int32()),
                        pa.array(end, pa.int32()),
                        pa.array(count, pa.int32()),
                        pa.array(digest, pa.binary()),
                    ],
                    names=["id", "start", "end", "n_words", "digest"],
                )

    return each


def _sign(width: int, rows: int, bands: int):
    """Distinct paragraphs in, with the keys of their bands out."""
    draw = np.random.default_rng(20)
    mult = draw.integers(1, 1 << 63, (rows * bands, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, (rows * bands, 1), dtype=np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            sizes = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
            words = _hashes(" ".join(texts).split(" "))
            ends = np.cumsum(sizes)
            wide = sizes >= width
            # Shingles of all texts in one go; those that reach into the next text are left out.
            owner = np.repeat(np.arange(len(texts)), sizes)
            whole = np.flatnonzero(np.arange(len(words)) + width <= np.repeat(ends, sizes))
            mins = np.full((rows * bands, len(texts)), ~np.uint64(0))
            grams = _rolled(words, width)[whole] if len(whole) else np.zeros(0, np.uint64)
            owner = owner[whole]
            for i in range(0, len(grams), _SHINGLES_AT_ONCE):
                mixed = grams[i : i + _SHINGLES_AT_ONCE] * mult + add
                mixed ^= mixed >> np.uint64(31)
                names, first = np.unique(owner[i : i + _SHINGLES_AT_ONCE], return_index=True)
                mins[:, names] = np.minimum(mins[:, names], np.minimum.reduceat(mixed, first, axis=1))
            for i in np.flatnonzero(~wide):  # a text of fewer words is its only shingle
                mixed = _rolled(words[ends[i] - sizes[i] : ends[i]], int(sizes[i])) * mult + add
                mins[:, i : i + 1] = mixed ^ (mixed >> np.uint64(31))
            keys = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(texts), 1)
            for row in range(rows):
                keys = keys * _MULT + mins[row::rows]
                keys ^= keys >> np.uint64(29)
            flat = np.ascontiguousarray((keys * _MULT).T).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["digest", "text", "bands"])

    return each


def _verify(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("y"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = shingles(x.split(" "), width), shingles(y.split(" "), width)
                keep.append(len(p & q) >= threshold * len(p | q))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(each, "a binary, b binary")


def _exact_rest(texts: DataFrame, open_: DataFrame, width: int, threshold: float) -> DataFrame:
    """Candidate pairs among the paragraphs `open_` (digest, class) of different classes, none of a similar pair missing.

    Two sets with the similarity share one of the rarest (1 - threshold) of their shingles, in the order of frequency; at the first
    one that they share, enough shingles must still follow in both. Variants that differ too much begin with so many shingles
    of their own that they meet nothing."""
    words = F.split("text", " ")
    n = F.greatest(F.size(words) - (width - 1), F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, width), " "))
    rows = texts.join(open_, "digest").select("digest", "class", F.array_distinct(grams).alias("g"))
    rows = settle(rows.select("digest", "class", F.transform("g", lambda s: F.xxhash64(s)).alias("g")), "open-paragraphs")
    each = rows.select("digest", F.explode("g").alias("s"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    rated = each.join(shared, "s").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("g"))
    size = F.size("g")
    prefix = F.slice("g", F.lit(1), size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)
    placed = F.transform(prefix, lambda x, i: F.struct(x["f"].alias("f"), x["s"].alias("s"), (size - i).alias("left")))
    rare = rated.select("digest", size.alias("size"), F.explode(F.filter(placed, lambda x: x["f"] > 1)).alias("x"))
    rare = rare.select("digest", "size", "x.s", "x.left").join(rows.select("digest", "class"), "digest")
    rare = settle(rare, "rare-shingles")
    left = rare.select("s", F.col("digest").alias("a"), F.col("class").alias("ca"), F.col("size").alias("na"), F.col("left").alias("la"))
    right = rare.toDF(*[f"{c}_" for c in rare.columns])
    # What can still be common from here on must reach the overlap that the similarity asks for.
    need = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("size_")) - 1e-9
    fits = (F.col("s") == F.col("s_")) & (F.col("ca") < F.col("class_")) & (F.least("la", "left_") >= need)
    return left.join(right, fits).select("a", F.col("digest_").alias("b")).distinct()


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    width: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
) -> DataFrame:
    """(id_col, start, end, n_words, class_id, kept_id, removed): one row per paragraph that is repeated in another document.

    Paragraphs are lines of at least `min_words` words (long ones in pieces, see `lines`), compared by their lower-case words, and
    runs of `min_words` words chosen by content across lines (see `stretches`), which only match equal ones: any 50 words in a row
    (STRETCH) that two documents share hold such a run. Rows of both kinds may overlap.
    Equal ones are one paragraph from the start. Distinct ones collide in MinHash bands tuned for `recall`; in each bucket all
    are compared with its first one and with the one that most others collide with (the original, as a rule), and links with an exact Jaccard similarity of `threshold` or more join classes.
    Only buckets that are then still in several classes go on: their paragraphs meet by rare shingles, which misses no
    similar pair. So a bucket is never expanded into all its pairs. Classes are the connected components of links.

    `class_id` and `kept_id` are the first occurrence of the class by (id, start): its start and its document; `removed` is true for
    all others. Places are code points. Classes within a single document are not reported. NULL and empty texts have no
    paragraphs; repeated rows with the same id count as one document; rows with a NULL id take part, are never kept before a known
    id, and are removed if a known one is. An empty table gives no rows. Other columns are not read.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType(
        [
            narrow.schema["id"],
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
        ]
    )
    units = settle(narrow.mapInArrow(_units(min_words, False), schema), "paragraphs")
    bodies = narrow.mapInArrow(_units(min_words, True), "digest binary, text string")
    rows, bands = tune_bands(threshold, recall)
    distinct = bodies.groupBy("digest").agg(F.first("text").alias("text"))
    signed = distinct.mapInArrow(_sign(width, rows, bands), "digest binary, text string, bands array<long>")
    signed = settle(signed, "signed-paragraphs")
    texts = signed.select("digest", "text")
    keys = signed.select("digest", F.explode("bands").alias("key"))
    bucket = W.partitionBy("key")  # one shuffle for the size of each bucket and its first member
    sized = keys.withColumns({"n": F.count(F.lit(1)).over(bucket), "low": F.min("digest").over(bucket)})
    shared = settle(sized.filter("n > 1"), "shared-bands")
    mates = shared.groupBy("digest").agg(F.sum("n").alias("mates"))
    central = shared.join(mates, "digest").groupBy("key").agg(F.max(F.struct("mates", "digest")).alias("top"))
    pairs = shared.join(central.select("key", F.col("top.digest").alias("high")), "key")
    pairs = pairs.select(F.explode(F.array("low", "high")).alias("a"), F.col("digest").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    links = settle(_verify(pairs, texts, width, threshold), "paragraph-links")
    classes = settle(connected_components(links), "paragraph-classes")
    named = shared.select("key", "digest").join(classes.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.select("key", "digest", F.coalesce("root", "digest").alias("class"))
    split = named.groupBy("key").agg(F.min("class").alias("p"), F.max("class").alias("q"), F.count(F.lit(1)).alias("n"))
    split = split.filter("p <> q and n > 2").select("key")
    open_ = settle(named.join(split, "key").select("digest", "class").distinct(), "open-classes")
    if not open_.isEmpty():
        more = _verify(_exact_rest(texts, open_, width, threshold), texts, width, threshold)
        merged = connected_components(links.unionByName(more))
        classes = settle(merged, "paragraph-classes")
    per_text = units.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "start")).alias("first"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    per_text = per_text.join(classes.withColumnRenamed("node", "digest"), "digest", "left")
    per_text = per_text.filter("root is not null or lo <> hi")  # what is alone in its class and in one document is not repeated
    per_text = settle(per_text.withColumn("root", F.coalesce("root", "digest")), "paragraph-firsts")
    per_class = per_text.groupBy("root").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    repeated = per_class.filter("lo <> hi").select("root", "first")
    known = per_text.select("digest", "root").join(repeated, "root").select("digest", "first")
    out = units.join(known, "digest")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("start") == F.col("first.start"))
    return out.select(
        F.col("id").alias(id_col), "start", "end", "n_words", F.col("first.id").alias("kept_id"),
        F.col("first.start").alias("kept_start"), (~same).alias("removed"),
    )


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the removed passages cut out of their texts; rows without any stay as they are."""
    gone_col, key = fresh(docs, "gone"), fresh(docs, "cut_id")
    spots = F.array_sort(F.collect_set(F.struct("start", "end")))
    gone = passages.filter("removed").groupBy(column(id_col).alias(key)).agg(spots.alias(gone_col))
    text = column(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        return F.struct(kept.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    cut = F.aggregate(gone_col, start, step, rest)
    joined = docs.join(gone, column(id_col).eqNullSafe(F.col(key)), "left")
    return joined.withColumn(text_col, F.when(F.col(gone_col).isNull(), text).otherwise(cut)).drop(gone_col, key)
