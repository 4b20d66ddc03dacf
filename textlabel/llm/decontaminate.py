"""Benchmark decontamination by a broadcast hash set of test n-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.llm.arrays import let, window_hashes
from textlabel.operators.joins import lookup_join, measured_bytes
from textlabel.session import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII digits and lower-case letters and everything beyond ASCII are word characters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Above this size the hash set is not inlined into the scan; windows meet it in a join instead.
SET_BYTES = 16 * 1024 * 1024


def normalise(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. Pure ASCII takes the faster function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Normalised words of a text; none for NULL."""
    return F.array_remove(F.split(normalise(F.coalesce(text, F.lit(""))), GAP), "")


def _joined(tokens: Column, start: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(tokens, start, length), " ")


def item_windows(items: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """(item, len, gram): the distinct windows of each item; an item of fewer words, but not none, is one window."""
    tokens = items.select(F.col(f"`{item_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (length - 1), F.lit(1)))
    rows = tokens.filter(n > 0).select("item", F.least(n, F.lit(length)).alias("len"), F.explode(starts).alias("i"), "w")
    return rows.select("item", "len", _joined(F.col("w"), F.col("i"), F.col("len")).alias("gram")).distinct()


def _with_hash(grams: DataFrame, lengths: list[int]) -> DataFrame:
    parts = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    value = F.lit(None).cast("bigint")
    for size in lengths:
        value = F.when(F.col("len") == size, window_hashes(parts, size)[0]).otherwise(value)
    return grams.withColumn("hash", value)


def scan_hits(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, length: int
) -> tuple[DataFrame, DataFrame]:
    """Per document row: (_row, id, n_words, hits), and the (hash, len, gram, item) table.

    `hits` lists the windows whose hash is in the set: position of the first word (from 0), length, text."""
    grams = settle(item_windows(items, item_col, item_text_col, length), "benchmark-grams")
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most `length` numbers
    keyed = settle(_with_hash(grams, lengths), "benchmark-hashes")
    sets = keyed.select("len", "hash").distinct()
    tokens = docs.select(F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("w"))
    if measured_bytes(sets) <= SET_BYTES:
        known: dict[int, list[int]] = {}
        for r in sets.collect():  # measured above
            known.setdefault(r["len"], []).append(r["hash"])

        def found(w: Column, hashes: Column, size: int) -> Column:
            at = F.transform(window_hashes(hashes, size), lambda h, i: F.when(h.isin(known[size]), i))
            spots = F.filter(at, lambda i: i.isNotNull())
            return F.transform(
                spots,
                lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), _joined(w, i + 1, size).alias("gram")),
            )

        none = F.array().cast("array<struct<pos:int,len:int,gram:string>>")

        def all_found(w: Column) -> Column:
            by_length = lambda hashes: F.concat(none, *[found(w, hashes, s) for s in lengths])
            return let(F.transform(w, lambda x: F.xxhash64(x)), by_length)

        hits = let(F.col("w"), all_found) if lengths else none
        return settle(tokens.select("id", F.size("w").cast("long").alias("n_words"), hits.alias("hits")), "window-hits"), keyed
    # A set too large to go with each task: windows are rows, and meet it in a join.
    rows = tokens.withColumn("_row", F.monotonically_increasing_id())
    rows = settle(rows, "document-words")
    spots = None
    for size in lengths:
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size))
        part = rows.select("_row", F.explode(starts).alias("pos"), F.lit(size).alias("len"), "w")
        part = part.select("_row", "pos", "len", _joined(F.col("w"), F.col("pos") + 1, size).alias("gram"))
        spots = part if spots is None else spots.unionByName(part)
    met = lookup_join(spots, keyed.select("gram", "len").distinct(), ["gram", "len"], spread=["_row", "pos"])
    met = met.groupBy("_row").agg(F.collect_list(F.struct("pos", "len", "gram")).alias("hits"))
    out = rows.select("_row", "id", F.size("w").cast("long").alias("n_words")).join(met, "_row", "left")
    none = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    return settle(out.select("id", "n_words", F.coalesce("hits", none).alias("hits")), "window-hits"), keyed


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = 10,
) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans, contaminated): one row per document row.

    Words are runs of digits, a-z (A-Z in lower case) and characters beyond ASCII. A window is `length`
    consecutive words of an item, or the whole of a shorter item. All windows of each document are looked up by
    hash in the set of test windows and verified by their words. `items` are the sorted ids of items with an
    occurring window, `spans` the hit word ranges (start, end exclusive), merged where they touch; `n_hit` counts
    words inside any of them.

    NULL and wordless texts have no words and no hits; wordless items never occur; an empty item table leaves
    all clean. Repeated rows and ids are judged each by itself, a NULL id as well. A NULL item id makes its
    words hit but is not listed. Other columns are not read.
    """
    scanned, keyed = scan_hits(docs, items, id_col, text_col, item_col, item_text_col, length)
    # Only occurring windows are looked up again; a text that a third of all documents share is one row here.
    seen = scanned.filter(F.size("hits") > 0).select(F.explode(F.col("hits.gram")).alias("gram")).distinct()
    owners = lookup_join(keyed.select("gram", "item"), seen, "gram", "left_semi")
    owners = settle(owners.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items")), "window-owners")
    clean = scanned.filter(F.size("hits") == 0).select(
        "id", "n_words", F.lit(0).cast("long").alias("n_hit"),
        F.array().cast(owners.schema["items"].dataType).alias("items"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    dirty = scanned.filter(F.size("hits") > 0).withColumn("_row", F.monotonically_increasing_id())
    dirty = settle(dirty, "hit-documents")  # fixes the row numbers
    spots = dirty.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    real = lookup_join(spots, owners, "gram", spread=["_row", "pos"])
    per_doc = real.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")))).alias("runs"),
    )
    named = real.select("_row", F.explode("items").alias("item")).distinct().groupBy("_row").agg(
        F.array_sort(F.collect_list("item")).alias("items")
    )
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    merged = F.aggregate(
        "runs",
        start,
        lambda acc, r: F.when(
            r["start"] <= acc["e"],
            F.struct(acc["done"].alias("done"), acc["s"].alias("s"), F.greatest(acc["e"], r["end"]).alias("e")),
        ).otherwise(
            F.struct(
                F.when(acc["s"] < 0, acc["done"])
                .otherwise(F.concat(acc["done"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("end")))))
                .alias("done"),
                r["start"].alias("s"),
                r["end"].alias("e"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("end")))),
    )
    spans = per_doc.select("_row", merged.alias("spans"))
    # A document whose hash hits all failed the comparison of words comes back with no span.
    hit = dirty.select("_row", "id", "n_words").join(spans, "_row", "left").join(named, "_row", "left").select(
        "id", "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])), F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast(owners.schema["items"].dataType)).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
    out = clean.unionByName(hit)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))
