"""Readers and writers for record tables, vectors and reports."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.functions.dictionaries import SNOWBALL_ENGLISH


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    rename: Mapping[str, str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Delimited file with a header. Give a schema for large inputs: without one, types are inferred in
    an extra pass. `rename` maps repaired duplicate headers (a second "Gender" reads as "Gender1") and
    other names. `multiline` allows line breaks inside quotes, but then a file cannot be split."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.withColumnsRenamed(dict(rename)) if rename else df


def read_table(spark: SparkSession, path: str, run_date: str | None = None) -> DataFrame:
    """A stored table; with `run_date`, only that run's folder is listed and read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("run_date") == F.lit(run_date).cast("date")) if run_date else df


def spread(df: DataFrame) -> DataFrame:
    """Share out a small table that a scan would read with fewer tasks than there are cores.

    The number of tasks is what the scan itself plans, from file and split sizes; a table that can fill the
    cluster is never shuffled. Rows are dealt evenly, whatever their keys.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_table(df: DataFrame, path: str, run_date: str | None = None) -> None:
    """Store a table under the date of the run; a second run of that day replaces only its own folder."""
    day = F.lit(run_date or datetime.date.today().isoformat()).cast("date")
    (
        df.withColumn("run_date", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


def write_by_outcome(df: DataFrame, path: str, fmt: str = "parquet", by: str = "outcome") -> None:
    """One folder per outcome (csv or parquet)."""
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_embeddings(
    spark: SparkSession, path: str, dim: int, token: str = "token", fmt: str = "text"
) -> DataFrame:
    """(token, vec) from lines "token v1 … vN", or from a Parquet or CSV table with a key column named
    by `token` and either one array column or N number columns."""
    if fmt == "text":
        parts = F.split(F.col("value"), " ")
        numbers = F.slice(parts, F.size(parts) - (dim - 1), dim)
        key = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - dim), " ")
        lines = spark.read.text(path).filter(F.size(parts) > dim)
        return lines.select(key.alias("token"), numbers.cast("array<double>").alias("vec"))
    reader = spark.read.format(fmt)
    df = (reader.option("header", True) if fmt == "csv" else reader).load(path)
    rest = [c for c in df.columns if c != token]
    if len(rest) == 1 and isinstance(df.schema[rest[0]].dataType, T.ArrayType):
        vec = F.col(f"`{rest[0]}`").cast("array<double>")
    elif len(rest) == dim:
        vec = F.array(*[F.col(f"`{c}`").cast("double") for c in rest])
    else:
        raise ValueError(f"{len(rest)} columns beside {token}, expected {dim} numbers or one array")
    return df.select(F.col(f"`{token}`").alias("token"), vec.alias("vec"))


def stopword_df(spark: SparkSession, name: str = "snowball", path: str | None = None) -> DataFrame:
    """(word): the Snowball list, the list that ships with Spark ("spark_english"), their union
    ("english"), or a text file with one word per line."""
    if path:
        words = spark.read.text(path).select(F.trim("value").alias("word"))
        return words.filter(F.col("word") != "").distinct()
    return spark.createDataFrame([(w,) for w in stopwords(name)], "word string")


def stopwords(name: str = "snowball") -> list[str]:
    if name == "snowball":
        return list(SNOWBALL_ENGLISH)
    from pyspark.ml.feature import StopWordsRemover

    ours = StopWordsRemover.loadDefaultStopWords("english")
    if name == "spark_english":
        return sorted(set(ours))
    if name == "english":
        return sorted({*SNOWBALL_ENGLISH, *ours})
    raise ValueError(f"unknown stop-word list {name}")


def inline_records(spark: SparkSession, rows: Sequence[tuple], schema: str = "id string, text string") -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
