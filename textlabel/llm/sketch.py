"""Document fingerprints: every shingle hash below a fixed fraction of the hash range. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.llm.arrays import let, window_hashes
from textlabel.session import settle

LOWEST = -(1 << 63)
ROWS_PER_BUCKET = 1024
MOST_BUCKETS = 1 << 16


def sketch(text: Column, width: int = 5, one_in: int = 8) -> Column:
    """The sorted distinct shingle hashes that are among the lowest 1/`one_in` of all 64-bit values.

    Shingles are `width` lower-case words that white space separates; a text of fewer words, but not none, is one
    shingle. A text of which no hash is low enough keeps its smallest one, so that it can still be told from others. NULL
    and wordless texts have an empty sketch. The sketch of a union of shingle sets is the union of their sketches (less the
    smallest hashes kept for want of others), so sketches of parts can be merged."""
    highest = LOWEST + (1 << 64) // one_in - 1

    def low(hashes: Column) -> Column:
        kept = F.filter(hashes, lambda h: h <= highest)
        return F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept))).otherwise(
            F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
        )

    def hashes(words: Column) -> Column:
        many = window_hashes_of(words, width)
        return F.when(F.size(words) >= width, many).otherwise(
            F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        )

    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    return let(words, lambda w: let(hashes(w), low))


def window_hashes_of(words: Column, width: int) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: window_hashes(h, width))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two shingle sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of `part` that are in `whole`, whatever the difference of their lengths."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def fingerprint(sketch_: Column) -> Column:
    """16 hex digits for each hash of a sketch."""
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """`docs` with `next_<c>` for each of `cols`: the value in the row that follows by ascending id; after the last, the first.

    Ids are numbers; NULL ids come last, rows with the same id follow each other by the other columns. Rows are dealt
    to ranges of ids of about a thousand rows (cut points are approximate quantiles, at most 65,536 of them, and only
    decide how work is spread). Each range also gets a copy of the first row of the next one, so nothing is sorted globally."""
    rows = docs.count()
    wanted = min(max(1, -(-rows // ROWS_PER_BUCKET)), MOST_BUCKETS)
    keyed = docs.withColumn("_key", F.coalesce(F.col(f"`{id_col}`").cast("double"), F.lit(float("inf"))))
    if wanted > 1:
        known = docs.select(F.col(f"`{id_col}`").cast("double").alias("_key")).filter("_key is not null")
        edges = known.approxQuantile("_key", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
        splits = [float("-inf"), *sorted(set(edges)), float("inf")]
        keyed = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(keyed) if len(splits) > 2 else keyed.withColumn("_bucket", F.lit(0.0))
    else:
        keyed = keyed.withColumn("_bucket", F.lit(0.0))
    first = keyed.groupBy("_bucket").agg(F.min(f"`{id_col}`").alias("_first"))
    order = W.orderBy("_bucket")  # one row for each range
    back = first.select(
        F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(W.partitionBy())).alias("_before"), "_first"
    )
    back = settle(back, "range-starts")
    copies = keyed.join(F.broadcast(back), F.col(f"`{id_col}`").eqNullSafe(F.col("_first")))
    copies = copies.withColumn("_bucket", F.col("_before")).select(*docs.columns, "_bucket", F.lit(1).alias("_copy"))
    both = keyed.select(*docs.columns, "_bucket", F.lit(0).alias("_copy")).unionByName(copies)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != id_col]
    following = W.partitionBy("_bucket").orderBy("_copy", F.col(f"`{id_col}`").asc_nulls_last(), *rest)
    out = both.withColumns({f"next_{c}": F.lead(f"`{c}`").over(following) for c in cols})
    return out.filter("_copy = 0").drop("_bucket", "_copy")


def edit_tail(text: Column, other: Column, parts: int = 4) -> Column:
    """The last floor(n / parts) code points replaced by the first as many (or all) of `other`."""
    n = F.char_length(text)
    cut = F.floor(n / parts).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, one_in: int = 8) -> DataFrame:
    """(id_col, text, edited, sketch, edited_sketch, next_sketch): each text, its edited form and their sketches.

    The edited form ends with the beginning of the next document. A NULL text is empty; empty texts and an empty
    table work like others (a single document is its own successor). Other columns are not read."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text"), width, one_in))
    rows = with_next(base, "id", ["text", "sketch"])
    edited = edit_tail(F.col("text"), F.col("next_text"))
    out = rows.select(F.col("id").alias(id_col), "text", edited.alias("edited"), "sketch", F.col("next_sketch"))
    return out.withColumn("edited_sketch", sketch(F.col("edited"), width, one_in))
