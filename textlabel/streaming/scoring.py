"""Scoring texts as they arrive. The batch functions are used as they are."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textlabel.functions.dictionaries import SUBSTANCES
from textlabel.operators.recode import tag_keywords


def stream_records(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def tag_stream(
    records: DataFrame, text: str = "text", dictionary: Mapping[str, Sequence[str]] = SUBSTANCES
) -> DataFrame:
    """Keyword flags on a stream: a plain projection, so there is no state to keep."""
    return tag_keywords(records, text, dictionary)


def score_stream(
    records: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Write the scored records of each micro-batch to `path`, one folder per batch.

    `score` is any batch function, such as `prepare` followed by `predict_complete`. A batch that is run
    again after a failure replaces its own folder, so every record is written once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
