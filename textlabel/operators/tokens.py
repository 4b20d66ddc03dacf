"""Word and n-gram tables, stop words, bigram pairs and the word graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabel.functions.dictionaries import SNOWBALL_ENGLISH
from textlabel.functions.text import ngram_array, part_of, tokenize
from textlabel.operators.joins import lookup_join
from textlabel.operators.recode import not_in

Stop = Sequence[str] | DataFrame

# Bigrams whose occurrences a task combines before they are shuffled, and the text whose bigrams one task sums up.
BIGRAMS_AT_ONCE = 1 << 20
TEXT_PER_TASK = 16 * 1024 * 1024


def tokens(df: DataFrame, id_col: str = "id", text: str = "text", lower: bool = True) -> DataFrame:
    """(id, pos, word): one row per word, `pos` from 0. No shuffle."""
    words = tokenize(text, lower)
    return df.select(id_col, F.posexplode(words).alias("pos", "word"))


def ngrams(
    df: DataFrame,
    id_col: str = "id",
    text: str = "text",
    n: int = 2,
    lower: bool = True,
    keep_null: bool = True,
    out: str = "bigram",
    rows: bool = True,
) -> DataFrame:
    """(id, n-gram): one row per run of n adjacent words; a text with fewer words gives one NULL row
    unless `keep_null` is off. Works inside the row, so there is no shuffle and no lag window.
    With `rows` off each text stays one row with the array of its n-grams, for what sums them up by text."""
    words = df.select(id_col, tokenize(text, lower).alias("_w"))
    grams = ngram_array("_w", n, keep_null=keep_null)
    return words.select(id_col, (F.explode(grams) if rows else grams).alias(out))


def remove_stopwords(df: DataFrame, stop: Stop = SNOWBALL_ENGLISH, word: str = "word") -> DataFrame:
    """Rows whose word is not a stop word. A list becomes a hashed set inside the filter; a table is
    joined, broadcast when its measured size allows it."""
    if isinstance(stop, DataFrame):
        return lookup_join(df, stop.select(F.col(stop.columns[0]).alias(word)).distinct(), word, "left_anti")
    return df.filter(not_in(word, stop))


def word_counts(df: DataFrame, text: str = "text", min_n: int = 0) -> DataFrame:
    """Occurrences per word; with `min_n`, only words with more. Counts combine before the shuffle."""
    words = df.select(F.explode(tokenize(text)).alias("word"))
    out = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") > min_n) if min_n else out


def common_words(
    df: DataFrame, text: str = "text", min_n: int = 10, stop: Stop = SNOWBALL_ENGLISH
) -> DataFrame:
    """Counts of frequent words without stop words. Both filters run on the counts, not on the tokens:
    the result is the same and far fewer rows meet them."""
    return remove_stopwords(word_counts(df, text, min_n), stop)


def top_words(counts: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent words, ties in word order (each task keeps k rows)."""
    return counts.orderBy(F.desc("n"), "word").limit(k)


def _combined(at_once: int):
    """(bigram, n) of each `at_once` rows of a task."""

    def counted(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        counts = pa.Table.from_batches(held).group_by("bigram", use_threads=False).aggregate([([], "count_all")])
        return counts.select(["bigram", "count_all"]).rename_columns(["bigram", "n"]).to_batches(max_chunksize=1 << 16)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= at_once:
                yield from counted(held)
                held, rows = [], 0
        if rows:
            yield from counted(held)

    return each


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences per bigram, with the NULL of too short texts counted as a bigram of its own.

    Nearly all bigrams of a task may be different, so a table of them would grow with its share of the texts. They are combined
    in pieces of bounded size, and summed up by as many tasks as the measured size of all texts asks for."""
    size = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_PER_TASK))
    words = df.select(tokenize(text).alias("_w"))
    grams = words.select(F.explode(ngram_array("_w", 2, keep_null=True)).alias("bigram"))
    pieces = grams.mapInArrow(_combined(BIGRAMS_AT_ONCE), "bigram string, n long").repartition(tasks, "bigram")
    return pieces.groupBy("bigram").agg(F.sum("n").alias("n"))


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = " ") -> DataFrame:
    """Split one column into several; missing pieces are NULL."""
    out = df.withColumns({name: part_of(col, sep, i) for i, name in enumerate(into)})
    return out.drop(col)


def filter_bigrams(df: DataFrame, stop: Stop = SNOWBALL_ENGLISH) -> DataFrame:
    """Bigrams whose words are both known and not stop words."""
    df = df.filter(F.col("word1").isNotNull())
    return remove_stopwords(remove_stopwords(df, stop, "word1"), stop, "word2")


def bigram_pairs(df: DataFrame, text: str = "text", stop: Stop = SNOWBALL_ENGLISH) -> DataFrame:
    """(word1, word2, n) without stop words. Bigrams are counted first, then split and filtered once
    per distinct bigram."""
    return filter_bigrams(separate(bigram_counts(df, text), "bigram", ["word1", "word2"]), stop).select(
        "word1", "word2", "n"
    )


def bigram_graph(pairs: DataFrame, min_n: int) -> tuple[DataFrame, DataFrame]:
    """Directed word graph of frequent pairs: (vertices(name), edges(src, dst, n))."""
    edges = pairs.filter(F.col("n") > min_n).select(
        F.col("word1").alias("src"), F.col("word2").alias("dst"), "n"
    )
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    return ends.distinct(), edges
