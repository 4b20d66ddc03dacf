"""From raw documents to token ids: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabel.llm import decontaminate, quality, queries, secrets, simhash
from textlabel.llm.names import fresh
from textlabel.session import settle


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.5 go."""
    model = queries.quality_model(spark, docs, sf_dir)
    score = fresh(docs, "score")
    return quality.with_score(docs, model, out_col=score).filter(F.col(score) >= 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, the one with the smallest id."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, width=3, max_distance=2))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go. Texts decide, so rows are told apart by their digest."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    items = queries.table(spark, sf_dir, "benchmark")
    judged = decontaminate.contamination(docs.select(digest.alias("digest"), "text"), items, id_col="digest", length=10)
    gone = fresh(docs, "gone")
    bad = judged.filter("contaminated").select(F.col("digest").alias(gone)).distinct()
    return docs.join(bad, digest == F.col(gone), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; `n_chars` follows the text where it changes."""
    spans = fresh(docs, "spans")
    found = secrets.find_secrets(docs, rate=0.05, out_col=spans)
    clean = secrets.redact(F.col("text"), F.col(spans))
    changed = F.size(spans) > 0
    chars = F.when(changed, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    # One after the other: in one projection the new text would stand in for the old one inside the lambdas of `chars`.
    return found.withColumn("n_chars", chars).withColumn("text", clean).drop(spans)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of ids and digests of ids and decoded texts, one row for each document."""
    return queries.piece_digests(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", encoding),
]

# Compression, SimHash and BPE have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
