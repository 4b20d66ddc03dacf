"""Spelling variants: words one edit apart, found by sorting the rotations of terminator-marked words (a permuterm list).

A word w gets the terminator at its end and is rotated to begin after each of its characters. Two words that differ
in character i have rotations that agree up to their last character, the edited one; and if v is w without character
i, that same beginning is a whole rotation of v. So all three edits are equality of a rotation's prefix: the list is
sorted by prefix and scanned group by group, and the members of a group are each other's neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.llm.names import column
from textlabel.session import settle

END = "\u0000"


def letter_runs(text: Column) -> Column:
    """Maximal runs of Latin letters up to U+00FF, A-Z in lower case; none in NULL."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))


def without(word: Column, at: Column) -> Column:
    """`word` without its code point number `at`, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, at, skipped, n, indel): 2 L + 1 rows for a word of L characters.

    Rows without `skipped` are whole rotations. The others leave out the rotation's last character, number `at` of the
    word. Deleting any of several equal neighbouring characters gives the same word: `indel` is true for the first of
    them only, so that an insertion or deletion shows in one group and no pair of words meets twice. `at` belongs to
    the key: it tells where the terminator stands, also in words that hold that character themselves.
    """
    size = F.char_length("word")
    spots = words.select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), 2 * size)).alias("spot"))
    whole = F.col("spot") <= F.col("size")
    spots = spots.select("word", "n", "size", whole.alias("whole"), F.when(whole, F.col("spot")).otherwise(F.col("spot") - F.col("size") - 1).alias("at"))
    after = F.substring(F.col("word"), F.when(F.col("whole"), F.col("at") + 1).otherwise(F.col("at") + 2), F.col("size"))
    here = F.substring(F.col("word"), F.col("at") + 1, F.lit(1))
    first = (F.col("at") == 0) | (F.substring(F.col("word"), F.col("at"), F.lit(1)) != here)
    return spots.select(
        F.concat(after, F.lit(END), F.substring(F.col("word"), F.lit(1), F.col("at"))).alias("prefix"),
        "at",
        F.when(~F.col("whole"), here).alias("skipped"),
        "n",
        (~F.col("whole") & first).alias("indel"),
    )


def neighbourhoods(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words (distinct, with counts `n`) that have a neighbour: how many, and the
    most frequent of them, ties by code points.

    Each group of the sorted rotations says for each member how many others it has and which is the most frequent, so
    rows grow with the rotations and not with pairs. Within a group words differ in one character at one place, so it
    has at most as many members as the alphabet has letters, and `skipped` orders them as the whole words would.
    """
    group = W.partitionBy("prefix", "at")
    listed = group.orderBy(F.col("skipped").isNull(), F.desc("n"), "skipped")
    every = listed.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("minus"), "skipped")
    scanned = rotations(words).select(
        "prefix", "at", "skipped", "n", "indel",
        F.row_number().over(listed).alias("place"),
        F.count("skipped").over(every).alias("replaced"),
        F.count(F.when(F.col("indel"), 1)).over(every).alias("longer"),
        F.max(F.when(F.col("skipped").isNull(), F.col("n"))).over(every).alias("shorter"),
        F.first(one).over(every).alias("top"),
        F.nth_value(one, 2).over(every).alias("next"),
        F.min(F.when(F.col("indel"), one)).over(every).alias("top_longer"),
    )
    before = F.expr("right(prefix, at)")
    after = F.expr("left(prefix, char_length(prefix) - at - 1)")
    word_of = lambda c: F.concat(before, c, after)
    is_whole = F.col("skipped").isNull()
    also = F.col("indel") & F.col("shorter").isNotNull()
    # Among those with a skipped character: the first of the others.
    other = F.when(F.col("replaced") > 1, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top")))
    chosen = lambda s: F.when(s.isNotNull(), F.struct(s["minus"].alias("minus"), word_of(s["skipped"]).alias("near")))
    short = F.when(also, F.struct((-F.col("shorter")).alias("minus"), F.concat(before, after).alias("near")))
    met = scanned.select(
        F.when(is_whole, F.concat(before, after)).otherwise(word_of(F.col("skipped"))).alias("word"),
        F.when(is_whole, F.col("longer")).otherwise(F.col("replaced") - 1 + also.cast("long")).alias("n_near"),
        F.when(is_whole, chosen(F.col("top_longer"))).otherwise(F.least(chosen(other), short)).alias("best"),
    ).filter("n_near > 0")
    out = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of each chain of forms. Steps double, so a chain of k words takes
    about log2(k) joins. Chains must not be circular."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = now.join(on, F.col("root") == F.col("_word"), "left")
        further = settle(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        now = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, word_col: str = "word", n_col: str = "n", factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root): each word with the number of words one edit away, its more usual form and
    the form at the end of the chain.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its most
    frequent near word (ties: smallest in code-point order) if that is at least `factor` times as frequent, and more
    frequent than the word itself; else NULL. `root` is the word itself where there is no form.

    Repeated rows of a word are added up and a NULL count is 0. NULL words are left out; the empty word is a word.
    Other columns are not read. An empty table gives an empty result.
    """
    named = words.select(column(word_col).alias("word"), F.coalesce(column(n_col).cast("long"), F.lit(0).cast("long")).alias("n"))
    known = settle(named.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    has = (F.col("near_n") >= factor * F.col("n")) & (F.col("near_n") > F.col("n"))
    joined = known.join(neighbourhoods(known), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"),
    )
    joined = settle(joined, "variants")
    roots = follow(joined.filter(F.col("form").isNotNull()))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
