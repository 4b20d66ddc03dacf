"""Concept annotation of texts from a lexicon, as joins.

A lexicon is a table (alias, entity, cui, semantic_type). Texts become n-grams of the lengths that
aliases have; these meet the lexicon on the normalised alias, or, with a threshold below one, on the
Jaccard similarity of their character 3-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.functions.text import ngram_array, tokenize
from textlabel.operators.joins import lookup_join
from textlabel.operators.scan import scan_aliases
from textlabel.session import settle

CONCEPT = ["entity", "cui", "semantic_type"]
# More different alias lengths than this are made by one loop over them instead of one expression for each.
UNROLLED_LENGTHS = 8
# With up to so many different 3-grams and sets of them among the aliases, tasks sort out n-grams that are similar to none.
MOST_PROBES = 2000
WORDS_AT_ONCE = 1 << 18
# A task remembers what became of so many n-grams.
MOST_KNOWN = 1 << 19


def _words(text: Column | str) -> Column:
    # Punctuation marks stay as tokens, so that no alias matches across a comma.
    return tokenize(text, lower=True, strip_punct=False)


def normalise(lexicon: DataFrame) -> DataFrame:
    words = _words("alias")
    return lexicon.select(
        F.array_join(words, " ").alias("gram"), F.size(words).alias("n_words"), *CONCEPT
    ).distinct()


def surface_grams(df: DataFrame, id_col: str, text: str, lengths: Sequence[int]) -> DataFrame:
    """(id, pos, n_words, gram) for n-grams of the given lengths; `pos` counts tokens from 0."""
    words = df.select(id_col, _words(text).alias("_w"))

    def placed(n: int) -> Column:
        return F.transform(
            ngram_array("_w", n),
            lambda gram, i: F.struct(i.cast("long").alias("pos"), F.lit(n).alias("n_words"), gram.alias("gram")),
        )

    def placed_all(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        gram = lambda i: F.array_join(F.slice("_w", i, n), " ")
        rows = F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("pos"), n.alias("n_words"), gram(i).alias("gram")))
        return F.when(F.size("_w") >= n, rows).otherwise(F.array().cast("array<struct<pos:bigint,n_words:int,gram:string>>"))

    if len(lengths) > UNROLLED_LENGTHS:
        grams = F.flatten(F.transform(F.array(*[F.lit(n) for n in lengths]), placed_all))
    else:
        grams = F.concat(*[placed(n) for n in lengths])
    return words.select(id_col, F.explode(grams).alias("g")).select(id_col, "g.pos", "g.n_words", "g.gram")


def char_grams(text: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only gram."""
    text = F.col(text) if isinstance(text, str) else text
    last = F.greatest(F.length(text) - F.lit(n - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))


def _prefix_rows(df: DataFrame, name: str, threshold: float) -> DataFrame:
    """(name, name_n, probe): one row per gram in the prefix of each gram set under a fixed order.

    Two sets with Jaccard >= t share a gram among the first |x| - ceil(t |x|) + 1 grams of each, whatever
    the order of grams, so joining only the prefixes loses no pair. The order is that of a hash, and the
    hash is also the join key; a clash of hashes only adds a candidate, which is compared as text later.
    """
    sets = df.select(F.col("gram").alias(name), char_grams("gram").alias("_set"))
    hashes = sets.select(name, F.size("_set").alias(f"{name}_n"), F.transform("_set", lambda g: F.xxhash64(g)).alias("_h"))
    size = F.col(f"{name}_n")
    keep = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    prefix = F.slice(F.array_sort("_h"), F.lit(1), keep)
    return hashes.select(name, f"{name}_n", F.explode(prefix).alias("probe"))


@dataclass(frozen=True)
class Sieve:
    """The 3-grams of the aliases, by which a task sorts out n-grams that no alias is similar to; it lets no similar one go.

    `holders` gives the aliases that have a 3-gram, `sizes` how many each has, `blanks` how many of them hold a blank."""

    holders: dict[str, list[int]]
    sizes: list[int]
    blanks: list[int]
    threshold: float

    @staticmethod
    def of(aliases: DataFrame, threshold: float) -> Sieve | None:
        """None if the aliases have more than `MOST_PROBES` different 3-grams, or sets of them."""
        sets = aliases.select("gram").distinct().filter("gram <> ''").select(F.array_sort(char_grams("gram")).alias("s"))
        if sets.select(F.explode("s").alias("g")).distinct().limit(MOST_PROBES + 1).count() > MOST_PROBES:
            return None
        distinct = [r["s"] for r in sets.distinct().limit(MOST_PROBES + 1).collect()]
        if len(distinct) > MOST_PROBES or not distinct:
            return None
        holders: dict[str, list[int]] = {}
        for i, grams in enumerate(distinct):
            for g in grams:
                holders.setdefault(g, []).append(i)
        return Sieve(holders, [len(s) for s in distinct], [sum(" " in g for g in s) for s in distinct], threshold)


def possible_grams(df: DataFrame, id_col: str, text: str, lengths: Sequence[int], sieve: Sieve) -> DataFrame:
    """Those rows of `surface_grams` whose n-gram the sieve keeps. Row by row: the others never leave the task.

    The 3-grams of an n-gram lie in its words or hold a blank. So what it shares with an alias is at most what its words share
    with it and the alias's 3-grams with a blank, and it has at least those of each word and one more. A word is `alone` if by this it
    may be in a similar n-gram whose other words share nothing with any alias. Only n-grams with such a word, or with two words
    that share something, are made and compared. Python looks only at words in which Arrow finds a 3-gram of an alias.
    """
    holders, counts, blanks, least = sieve.holders, sieve.sizes, sieve.blanks, sieve.threshold - 1e-9

    def shared(grams: set[str]) -> dict[int, int]:
        common: dict[int, int] = {}
        for g in grams:
            for alias in holders.get(g, ()):
                common[alias] = common.get(alias, 0) + 1
        return common

    def kept(gram: str) -> bool:
        grams = {gram[i : i + 3] for i in range(max(len(gram) - 2, 1))}
        return any(n >= least * (len(grams) + counts[alias] - n) for alias, n in shared(grams).items())

    def alone(word: str) -> bool:
        grams = {word[i : i + 3] for i in range(len(word) - 2)}
        common = {**with_blanks, **{a: n + blanks[a] for a, n in shared(grams).items()}}
        return any(n >= least * (len(grams) + 1 + counts[a] - n) for a, n in common.items())

    with_blanks = {a: n for a, n in enumerate(blanks) if n}
    pattern, other_alone = "|".join(re.escape(g) for g in holders), alone("")

    def flags(values: list[str], known: dict, test) -> np.ndarray:
        if len(known) > MOST_KNOWN:
            known.clear()
        known.update({v: test(v) for v in values if v not in known})
        return np.array([known[v] for v in values], bool)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Ids, word lists and their lengths, of rows with some 262,144 words together unless one has more."""
        sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + WORDS_AT_ONCE, "right")))
            yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), sizes[start:stop]
            start = stop

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_alone = {}, {}
        for batch in batches:
            for ids, words, sizes in pieces(batch):
                flat = words.flatten().dictionary_encode()
                code = flat.indices.to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                some = pc.match_substring_regex(flat.dictionary, pattern).to_numpy(zero_copy_only=False).astype(bool)
                sharing = flat.dictionary.filter(pa.array(some)).to_pylist()
                single, strong = np.zeros(len(some), bool), np.full(len(some), other_alone)
                single[some], strong[some] = flags(sharing, known, kept), flags(sharing, known_alone, alone)
                weight = (some + 2 * strong)[code]
                for n in lengths:
                    m = max(len(row) - n + 1, 0)
                    if n == 1:
                        at = np.flatnonzero(single[code])
                    else:
                        near = sum(weight[i : m + i] for i in range(n)) >= 2
                        at = np.flatnonzero(near & (row[:m] == row[n - 1 :]))
                    parts = [flat.dictionary.take(pa.array(code[at + i])) for i in range(n)]
                    found = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                    if n > 1:
                        coded = found.dictionary_encode()
                        good = flags(coded.dictionary.to_pylist(), known, kept)[coded.indices.to_numpy()]
                        at, found = at[good], found.filter(pa.array(good))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[at])), pa.array(place[at]), pa.array(np.full(len(at), n, np.int32)), found],
                        names=["id", "pos", "n_words", "gram"],
                    )

    kind = df.schema[id_col].dataType
    schema = T.StructType().add("id", kind).add("pos", "long").add("n_words", "integer").add("gram", "string")
    return df.select(F.col(f"`{id_col}`").alias("id"), _words(text).alias("_w")).mapInArrow(each, schema).withColumnRenamed("id", id_col)


def similar_grams(surfaces: DataFrame, aliases: DataFrame, threshold: float) -> DataFrame:
    """(gram, alias, score) for every pair with Jaccard similarity of 3-grams at or above `threshold`.

    Both inputs have a column `gram`. Exact: prefix and size filters only remove pairs that cannot reach
    the threshold. Rows stay narrow until then; gram sets are built again for the few pairs that are left.
    """
    left = _prefix_rows(surfaces.select("gram").distinct(), "s", threshold)
    right = _prefix_rows(aliases.select("gram").distinct(), "a", threshold)
    met = lookup_join(left, right, "probe", spread=["s"])
    small, large = F.least("s_n", "a_n"), F.greatest("s_n", "a_n")
    fits = met.filter(small >= F.lit(threshold) * large - F.lit(1e-9)).select("s", "a")
    sets = fits.withColumns({"s_set": char_grams("s"), "a_set": char_grams("a")})
    common = sets.withColumn("both", F.size(F.array_intersect("s_set", "a_set")))
    score = F.col("both") / (F.size("s_set") + F.size("a_set") - F.col("both"))
    pairs = common.withColumn("score", score).filter(F.col("score") >= threshold)
    return pairs.select(F.col("s").alias("gram"), F.col("a").alias("alias"), "score").distinct()


def scan(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text: str = "text", overlaps: str = "all") -> DataFrame:
    """Exact mentions (id, pos, gram, entity, cui, semantic_type) by one pass over each text, whatever lengths aliases have.

    All of them as in `annotate`, or with `overlaps="longest"` the longest at each place, read from the left without overlap."""
    lex = normalise(lexicon)
    aliases = lex.select("gram").distinct().filter("gram <> ''").select(F.col("gram").alias("alias"), F.split("gram", " ").alias("words"))
    words = df.select(F.col(id_col).alias("id"), _words(text).alias("words"))
    found = scan_aliases(words, aliases, overlaps)
    named = lex.select(F.col("gram").alias("alias"), *CONCEPT)
    out = lookup_join(found, named, "alias", spread=["id", "pos"])
    return out.select(F.col("id").alias(id_col), "pos", F.col("alias").alias("gram"), *CONCEPT)


def annotate(
    df: DataFrame, lexicon: DataFrame, id_col: str = "id", text: str = "text", threshold: float = 1.0
) -> DataFrame:
    """Mentions (id, pos, gram, entity, cui, semantic_type, score).

    Exact alias match at threshold 1. Below it, each text is read once and gives the n-grams that its task cannot sort out
    (`Sieve`); they are stored, each distinct one is compared with the lexicon, and the matches are joined back to where it
    occurs. With a lexicon too large for a sieve (`MOST_PROBES`) all n-grams are compared. Overlapping mentions
    are all kept. The lexicon is broadcast when its measured size allows it.
    """
    lex = normalise(lexicon)
    # The different lengths of aliases in words; one number each, whatever the size of the lexicon.
    lengths = sorted(r["n_words"] for r in lex.select("n_words").distinct().collect())
    lengths = [n for n in lengths if n > 0]
    if threshold >= 1.0 and len(lengths) > UNROLLED_LENGTHS:
        return scan(df, lexicon, id_col, text).withColumn("score", F.lit(1.0))
    sieve = Sieve.of(lex, threshold) if 0 < threshold < 1.0 else None
    if sieve:
        grams = settle(possible_grams(df, id_col, text, lengths, sieve), "possible-grams")
    else:
        grams = surface_grams(df, id_col, text, lengths)
    if threshold >= 1.0:
        found = lookup_join(grams, lex.drop("n_words"), "gram", spread=[id_col, "pos"])
        return found.select(id_col, "pos", "gram", *CONCEPT, F.lit(1.0).alias("score"))
    pairs = similar_grams(grams, lex, threshold)
    named = pairs.join(lex.select(F.col("gram").alias("alias"), *CONCEPT), "alias").drop("alias")
    found = lookup_join(grams, named, "gram", spread=[id_col, "pos"])
    return found.select(id_col, "pos", "gram", *CONCEPT, "score")


def filter_concepts(
    mentions: DataFrame, semantic_type: str = "Organic Chemical", entities: Sequence[str] = ()
) -> DataFrame:
    """Mentions of one semantic type, plus those of the named entities whatever their type."""
    keep = F.col("semantic_type") == semantic_type
    if entities:
        keep = keep | F.col("entity").isin(list(entities))
    return mentions.filter(keep)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, all columns kept. A hash aggregate, not a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def collapse(df: DataFrame, id_col: str, col: str, order: Sequence[str], sep: str = " ", out: str = "text") -> DataFrame:
    """Values of one record joined into a string in the given order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(col).alias("_v"))))
    text = F.array_join(F.transform(items, lambda item: item["_v"]), sep)
    return df.groupBy(id_col).agg(text.alias(out))


def concept_strings(mentions: DataFrame, id_col: str = "id", out: str = "cui") -> DataFrame:
    """Per record the concept ids of its distinct entities, in order of first mention.

    Partitioning by record first lets both aggregates share one shuffle; a record has at most as many
    mentions as its text has words.
    """
    by_record = mentions.repartition(F.col(id_col))
    firsts = first_per(by_record, [id_col, "entity"], ["pos", "cui"])
    return collapse(firsts, id_col, "cui", ["pos", "entity"], " ", out)
