"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, makes a text smaller."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabel.llm.names import fresh
from textlabel.session import settle

# Texts are compressed in blocks of so many bytes, so that a dictionary weighs as much at the end of a long text as at its beginning.
BLOCK = 8192
LEVEL = 3


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    intercept: float
    weights: list[float]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=params)
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=params)


def features(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """(texts x 3): normalised difference of the sizes with the bad and the good dictionary, compressed share of the
    raw size without a dictionary, and the difference of the two sizes as a share of the raw size. Zeros for empty texts."""
    plain, with_good, with_bad = _compressor(b""), _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if not data:
            continue
        blocks = [data[j : j + BLOCK] for j in range(0, len(data), BLOCK)]
        p, g, b = (sum(len(c.compress(x)) for x in blocks) for c in (plain, with_good, with_bad))
        out[i] = (b - g) / (b + g), min(p / len(data), 2.0), (b - g) / len(data)
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Raw content for a compressor: what zstandard's trainer picks out of the samples, or the samples themselves if they are few."""
    total = sum(map(len, samples))
    if total <= size or len(samples) < 16:
        return b"".join(samples)[-size:]
    return zstandard.train_dictionary(size, samples).as_bytes()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    samples: int = 4000,
    sample_bytes: int = 4096,
    dictionary_bytes: int = 1 << 17,
    calibration_rows: int = 20_000,
) -> CompressionClassifier:
    """Dictionaries and calibration from the documents that `labels` (id_col, label_col 0 or 1) names.

    The halves of the labels by hash of their id serve one purpose each, so that no text is scored with a dictionary it is in.
    From the first half at most `samples` of each label, the first in order of a hash of their ids, are chosen; each of these
    documents gives one hash-chosen piece of `sample_bytes` to train its label's dictionary (at most 2 x samples x sample_bytes come
    to the driver). From the second half about `calibration_rows` of each label, chosen by hash, calibrate the score by a logistic
    regression on the compressed sizes of their whole texts. Both choices are made among the labels alone, and their ids (of
    that bounded number) are broadcast to the documents, whose texts are never shuffled.
    Labels other than 0 and 1, NULLs and documents without text are left out. If a label is missing in a half, the score is constant:
    the smoothed share of label 1.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    draw = F.xxhash64(F.col("label_id").cast("string"), F.lit(7))
    rows = rows.filter("y in (0, 1) and label_id is not null").withColumn("draw", draw).withColumn("half", F.pmod("draw", F.lit(2)))
    counts = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1 = sum(n for (_, y), n in counts.items() if y == 1)
    n0 = sum(n for (_, y), n in counts.items() if y == 0)
    constant = CompressionClassifier(b"", b"", float(np.log((n1 + 1) / (n0 + 1))), [0.0, 0.0, 0.0])
    if len(counts) < 4:
        return constant
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")

    def named(chosen: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    def first(label: int) -> DataFrame:
        return rows.filter((F.col("half") == 0) & (F.col("y") == label)).orderBy("draw", "label_id").limit(samples)

    pieces = F.greatest(F.ceil(F.char_length("text") / sample_bytes), F.lit(1))
    begin = (F.pmod(F.xxhash64("draw", F.lit(11)), pieces) * sample_bytes + 1).cast("int")
    piece = F.substring(F.col("text"), begin, F.lit(sample_bytes)).alias("piece")
    sampled = named(first(0).unionByName(first(1)).select("label_id", "y", "draw")).select("y", "draw", piece).collect()
    found = {}
    for label in (0, 1):
        mine = sorted((r["draw"], r["piece"]) for r in sampled if r["y"] == label)
        found[label] = _dictionary([text.encode()[:sample_bytes] for _, text in mine], dictionary_bytes)

    def share(label: int) -> float:
        return min(1.0, calibration_rows / counts[1, label])

    limits = {y: int(share(y) * (1 << 63)) * 2 - (1 << 63) - 1 for y in (0, 1)}  # of hashes, in proportion to the share
    chance = F.xxhash64("draw", F.lit(13))
    some = (chance <= limits[1]) & (F.col("y") == 1) | (chance <= limits[0]) & (F.col("y") == 0)
    chosen = rows.filter((F.col("half") == 1) & some).select("label_id", "y")
    measured = settle(_measured(named(chosen).select("y", "text"), found[1], found[0]).select("y", "f"), "calibration")
    seen = {r["y"] for r in measured.select("y").distinct().collect()}
    if seen != {0, 1}:
        return constant
    # Sampled labels get back the weight of the rows they stand for.
    weight = F.when(F.col("y") == 1, 1 / share(1)).otherwise(1 / share(0))
    model = LogisticRegression(regParam=1e-4, maxIter=100, weightCol="w").fit(
        measured.select(F.col("y").cast("double").alias("label"), array_to_vector("f").alias("features"), weight.alias("w"))
    )
    return CompressionClassifier(found[1], found[0], float(model.intercept), [float(x) for x in model.coefficients])


def _measured(rows: DataFrame, good: bytes, bad: bytes, text_col: str = "text", out_col: str = "f") -> DataFrame:
    """`rows` with the measurements of their texts. The dictionaries travel as one broadcast of bounded size, and only texts
    go to the workers; all other columns stay where they are."""
    shared = rows.sparkSession.sparkContext.broadcast((good, bad))

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(list(texts), *shared.value)))

    return rows.withColumn(out_col, F.pandas_udf(each, "array<double>")(F.col(f"`{text_col}`")))


def with_score(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """`docs` with `out_col`: the calibrated chance (0 to 1) that the label of the whole text is 1.

    Row-local; all columns are kept, `out_col` must be new. NULL and empty texts compress to nothing and get the score of
    all-zero measurements. Repeated rows are scored alike; an empty table gives no rows."""
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} exists")
    sizes = fresh(docs, "sizes")
    measured = _measured(docs, model.good, model.bad, text_col, sizes)
    z = F.lit(model.intercept)
    for i, w in enumerate(model.weights):
        z = z + F.lit(w) * F.col(sizes)[i]
    return measured.withColumn(out_col, 1 / (1 + F.exp(-z))).drop(sizes)
