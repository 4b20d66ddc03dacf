"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabel.llm import (
    decontaminate, language, licenses, passages, pieces, quality, runs, secrets, simhash, sketch, url_filter, variants, warc,
)
from textlabel.llm.arrays import let
from textlabel.session import new_table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hex64(c: Column | str) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


@register
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf, "documents"), width=3, max_distance=2)
    return out.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@register
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), length=10)
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )


_SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
SQL["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(w[i : i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
      array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@register
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "archive")
    warc.write_archive(table(spark, sf, "pages"), path, min_revisit_bytes=0)
    out = warc.read_archive(spark, path)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS newest, sha1(body) AS hex FROM p)
SELECT page_id, octet_length(body) AS payload_bytes,
    translate(array_to_string(list_transform(range(8), lambda i: to_base(CAST('0x' || hex[5 * i + 1 : 5 * i + 5] AS BIGINT), 32, 4)), ''),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < newest THEN newest END AS refers_to, true AS intact
FROM r
"""

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@register
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose number its url carries. All hosts lie under
    example.com, .net or .org, which are the suffixes here."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"^.*?://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    numbered = pages.filter(number != "").select("page_id", number.cast("long").alias("doc_id"))
    outcomes = numbered.join(table(spark, sf, "labels"), "doc_id").select("page_id", (1 - F.col("quality")).alias("bad"))
    return url_filter.judge(pages, outcomes, URL_RULES, suffix_labels=2).select("page_id", "host", "path", "rule", "verdict")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text."""
    import public_tokenizers

    out = pieces.encode_decode(docs, model or str(public_tokenizers.path("piece_bpe_32k.model")), end=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return piece_digests(table(spark, sf, "documents"))


@register
def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf, "documents").select("doc_id", "text"), rate=0.05).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["name"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


@register
def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = sketch.compare_with_edits(table(spark, sf, "documents"), width=5, one_in=8)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )


def id_remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


@register
def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.fit(docs.filter(id_remainder(4) != 2))
    out = language.identify(docs, model)
    held = F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "lang_pred", "score")


def quality_model(spark: SparkSession, docs: DataFrame, sf: str) -> quality.CompressionClassifier:
    """Learned from labels of ids whose remainder by three is not 1."""
    return quality.fit(docs, table(spark, sf, "labels").filter(id_remainder(3) != 1))


@register
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = quality.with_score(docs, quality_model(spark, docs, sf))
    held = F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op2_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents"), min_words=20, width=5, threshold=0.8)


@register
def op11_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words are runs of letters; one in 31 loses a letter, as a typing error would take it."""
    docs = table(spark, sf, "documents")
    found = docs.select("doc_id", F.explode(variants.letter_runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % 31 == 0, variants.without(F.col("run"), at)).otherwise(F.col("run"))
    words = found.select(word.alias("word")).filter(F.char_length("word") >= 7)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return variants.spelling_variants(counted, factor=10)


LICENSE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


@register
def op12_licenses(spark: SparkSession, sf: str) -> DataFrame:
    rules = [*licenses.phrase_rules(LICENSE_PHRASES), *licenses.signature_rules()]
    found = licenses.find_licenses(table(spark, sf, "documents").select("doc_id", "text"), rules)
    base = F.filter("license_found", lambda f: f["base"])
    names = lambda f: F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda x: x["label"]))), ",")
    first = F.transform(base, lambda f: f["first"])
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("license_found")).alias("labels"), F.col("license_score").alias("score"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by their id, the words after one place repeat from there on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


@register
def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, sf, "documents")), min_length=6, min_exponent=4)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", told.alias("told"), best.alias("best")).select(
        "doc_id", "n_runs", "best.start", (-F.col("best.minus")).alias("length"), "best.period",
        F.floor(-1000 * F.col("best.minus") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
