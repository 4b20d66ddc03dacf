"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that operators use inside.
CLASHES = [
    "id", "fp", "key", "page", "words", "hits", "w", "n", "root", "node", "a", "b", "rep", "digest", "band", "score", "sizes",
    "spans", "gone", "again", "start", "class", "item", "hash", "host", "path", "rule", "_bucket", "_copy", "_key", "_row", "payload",
]
PROSE = (
    "the quick brown fox jumps over the lazy dog while seven other animals watch from behind an old wooden fence near the river. "
    "Nobody knows why they came, but everyone agrees that it was a fine day for a walk along the water and back again. "
)


def with_clashes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in df.columns})


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows as a table of documents with columns in the way."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return with_clashes(df)


def odd_rows() -> list[tuple]:
    long = " ".join(f"word{i % 977} {PROSE}" for i in range(400))
    return [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "   \t\n "), (None, PROSE.upper()), (None, None),
        (6, "one"), (7, "É é ü ß 😀 日本語"), (8, long), (9, long + " end"), (10, "a\0b  c"), (11, "." * 5000), (12, PROSE + "more"),
    ]
