"""Vocabulary, TF-IDF and summed word vectors. `fit_*` sees only the fitting rows; the result is applied
to any rows, row by row, without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabel.functions.dictionaries import SNOWBALL_ENGLISH
from textlabel.functions.text import token_pattern, tokenize
from textlabel.operators.joins import lookup_join
from textlabel.session import settle

# Largest vocabulary kept as literals in the plan (the default recipe keeps 100 words).
INLINE_VOCABULARY = 20_000
# A table of 400,000 word vectors with 100 numbers each takes about 330 MB.
VECTOR_BROADCAST_BYTES = 512 * 1024 * 1024


def _token_rows(df: DataFrame, tokens: Column | str, *more: str) -> DataFrame:
    """(token, new, …): one row per occurrence, `new` = 1 on a token's first row within its text.

    Each text's tokens are sorted inside the row, so the first of equal neighbours marks a document;
    that avoids a shuffle by (document, token) and a distinct count.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    rows = df.select(*more, F.array_sort(tokens).alias("_s"))
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))))
    marked = rows.select(*more, F.explode(F.arrays_zip(F.col("_s").alias("t"), prev.alias("p"))).alias("z"))
    new = (~F.coalesce(F.col("z.t") == F.col("z.p"), F.lit(False))).cast("long")
    return marked.filter(F.col("z.t").isNotNull()).select(*more, F.col("z.t").alias("token"), new.alias("new"))


def token_stats(df: DataFrame, tokens: Column | str, weight: str | None = None) -> DataFrame:
    """(token, n, df): occurrences and documents per token in one pass and one shuffle. A row with a whole-number
    `weight` counts as that many rows."""
    rows = _token_rows(df, tokens, *([weight] if weight else []))
    if not weight:
        return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("df"))
    times = F.col(f"`{weight}`").cast("long")
    return rows.groupBy("token").agg(F.sum(times).alias("n"), F.sum(F.col("new") * times).alias("df"))


def fold_token_stats(df: DataFrame, tokens: Column | str, fold: str, v: int) -> list[DataFrame]:
    """Per fold the `token_stats` of the other folds, all from one pass over the texts.

    Counts per token and fold are summed side by side and stored; what a fold is fitted on is the total
    minus that fold. Ten folds thus cost one tokenization instead of ten.
    """
    rows = _token_rows(df, tokens, fold)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("new").alias("df")]
    for f in range(v):
        here = F.col(fold) == f
        sums.append(F.sum(F.when(here, 1).otherwise(0)).alias(f"n{f}"))
        sums.append(F.sum(F.when(here, F.col("new")).otherwise(0)).alias(f"df{f}"))
    table = settle(rows.groupBy("token").agg(*sums), "fold-tokens")
    return [
        table.select("token", (F.col("n") - F.col(f"n{f}")).alias("n"), (F.col("df") - F.col(f"df{f}")).alias("df"))
        for f in range(v)
    ]


def fit_vocabulary(stats: DataFrame, min_times: int = 5, max_tokens: int | None = 100) -> DataFrame:
    """Tokens seen at least `min_times`, the `max_tokens` most frequent of them, ties by token.

    The cut comes before stop words are dropped, so fewer than `max_tokens` features may remain.
    """
    kept = stats.filter(F.col("n") >= min_times)
    if max_tokens is None:
        return kept
    return kept.orderBy(F.desc("n"), "token").limit(max_tokens)


def idf(n_docs: Column | int, doc_freq: Column) -> Column:
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log(F.lit(1.0) + n.cast("double") / doc_freq.cast("double"))


def tokenize_stage(text: str, out: str = "tokens", lower: bool = True, strip_punct: bool = True) -> SQLTransformer:
    """The tokenizer as a pipeline stage that can be saved."""
    col = f"coalesce(`{text}`, '')"
    if lower:
        col = f"lower({col})"
    pattern = token_pattern(strip_punct)
    return SQLTransformer(
        statement=f'SELECT *, regexp_extract_all({col}, r"{pattern}", 0) AS `{out}` FROM __THIS__'
    )


def _bounded_rows(vocab: DataFrame, what: str) -> list:
    rows = vocab.limit(INLINE_VOCABULARY + 1).collect()
    if len(rows) > INLINE_VOCABULARY:
        raise ValueError(f"{what} above {INLINE_VOCABULARY} tokens: set max_tokens, or use `terms.WideTfidf` or `doc_embedding`, which join")
    if not rows:
        raise ValueError(f"no token is frequent enough for {what}")
    return rows


@dataclass
class TfidfRecipe:
    """Tokens, frequency filter, stop words, TF-IDF."""

    text: str = "text"
    lower: bool = True
    strip_punct: bool = True
    min_times: int = 5
    max_tokens: int = 100
    stop: Sequence[str] = field(default_factory=lambda: SNOWBALL_ENGLISH)
    out: str = "features"

    @property
    def inputs(self) -> list[str]:
        return [self.text]

    def _tokens(self) -> Column:
        return tokenize(self.text, self.lower, self.strip_punct)

    def _kept(self, stats: DataFrame) -> DataFrame:
        vocab = fit_vocabulary(stats, self.min_times, self.max_tokens)
        return vocab.filter(~F.col("token").isin(list(self.stop))) if self.stop else vocab

    def vocabulary(self, df: DataFrame, weight: str | None = None) -> DataFrame:
        """(token, n, df) of the features, in feature order."""
        return self._kept(token_stats(df, self._tokens(), weight))

    def fit(self, df: DataFrame, weight: str | None = None) -> TfidfModel:
        """Rows with a whole-number `weight` count as that many rows."""
        rows = df.agg(F.sum(F.col(f"`{weight}`").cast("long"))).first()[0] or 0 if weight else df.count()
        return self._model(self.vocabulary(df, weight), rows)

    def fit_folds(self, df: DataFrame, fold: str, v: int) -> list[TfidfModel]:
        """One model per fold, fitted on the rows of the other folds."""
        stats = fold_token_stats(df, self._tokens(), fold, v)
        sizes = {r[fold]: r["count"] for r in df.groupBy(fold).count().collect()}
        total = sum(sizes.values())
        return [self._model(self._kept(s), total - sizes.get(f, 0)) for f, s in enumerate(stats)]

    def _model(self, vocab: DataFrame, n_docs: int) -> TfidfModel:
        rows = _bounded_rows(vocab, "TF-IDF")
        rows.sort(key=lambda r: (-r["n"], r["token"]))
        terms = [r["token"] for r in rows]
        weights = Vectors.dense(np.log(1.0 + n_docs / np.array([float(r["df"]) for r in rows])))
        stages = [
            tokenize_stage(self.text, "_tokens", self.lower, self.strip_punct),
            CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol="_counts"),
            Normalizer(p=1.0, inputCol="_counts", outputCol="_tf"),
            ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol=self.out),
        ]
        return TfidfModel(PipelineModel(stages), terms)


@dataclass
class TfidfModel:
    pipeline: PipelineModel
    terms: list[str]

    def transform(self, df: DataFrame, keep_parts: bool = False) -> DataFrame:
        """Add the feature vector; a text without a kept token gets a zero vector, not a missing row."""
        out = self.pipeline.transform(df)
        return out if keep_parts else out.drop("_tokens", "_counts", "_tf")

    def after_tokens(self, df: DataFrame) -> DataFrame:
        """Features of rows that have `_tokens` already."""
        for stage in self.pipeline.stages[1:]:
            df = stage.transform(df)
        return df.drop("_counts", "_tf")

    def long(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, token, tf, tfidf) for the tokens a text has."""
        parts = self.transform(df, keep_parts=True)
        names = F.array(*[F.lit(t) for t in self.terms])
        cells = F.arrays_zip(
            names.alias("token"),
            vector_to_array("_tf").alias("tf"),
            vector_to_array(self.pipeline.stages[-1].getOutputCol()).alias("tfidf"),
        )
        hit = parts.select(id_col, F.explode(F.filter(cells, lambda c: c["tf"] > 0)).alias("c"))
        return hit.select(id_col, "c.token", "c.tf", "c.tfidf")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> TfidfModel:
        pipeline = PipelineModel.load(path)
        return TfidfModel(pipeline, list(pipeline.stages[1].vocabulary))


@dataclass
class EmbeddingRecipe:
    """Tokens, frequency filter, optional stop words, sum of the token vectors."""

    vectors: DataFrame  # token, vec
    dim: int
    text: str = "text"
    lower: bool = False
    strip_punct: bool = True
    min_times: int = 5
    max_tokens: int = 100
    stop: Sequence[str] = field(default_factory=lambda: SNOWBALL_ENGLISH)
    out: str = "features"

    @property
    def inputs(self) -> list[str]:
        return [self.text]

    def _tokens(self) -> Column:
        return tokenize(self.text, self.lower, self.strip_punct)

    def fit(self, df: DataFrame, weight: str | None = None) -> EmbeddingModel:
        return self._model(token_stats(df, self._tokens(), weight))

    def fit_folds(self, df: DataFrame, fold: str, v: int) -> list[EmbeddingModel]:
        """One model per fold, fitted on the rows of the other folds."""
        return [self._model(stats) for stats in fold_token_stats(df, self._tokens(), fold, v)]

    def _model(self, stats: DataFrame) -> EmbeddingModel:
        vocab = fit_vocabulary(stats, self.min_times, self.max_tokens).select("token")
        if self.stop:
            vocab = vocab.filter(~F.col("token").isin(list(self.stop)))
        # The vocabulary is at most max_tokens rows, so it, and not the vector table, is broadcast.
        known = lookup_join(self.vectors.select("token", "vec"), vocab, "token", "left_semi")
        rows = sorted(_bounded_rows(known, "word vectors"), key=lambda r: r["token"])
        matrix = np.array([[float(x) for x in r["vec"]] for r in rows])
        if matrix.shape[1] != self.dim:
            raise ValueError(f"vectors have {matrix.shape[1]} numbers, not {self.dim}")
        stages = [
            tokenize_stage(self.text, "_tokens", self.lower, self.strip_punct),
            CountVectorizerModel.from_vocabulary([r["token"] for r in rows], inputCol="_tokens", outputCol="_counts"),
        ]
        return EmbeddingModel(PipelineModel(stages), matrix, self.out)


@dataclass
class EmbeddingModel:
    pipeline: PipelineModel
    matrix: np.ndarray
    out: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the summed vector. Only the short count vector of a text goes to Python, a batch at a
        time, for one matrix product; texts stay in the JVM and nothing is shuffled."""
        return self.after_tokens(self.pipeline.stages[0].transform(df)).drop("_tokens")

    def after_tokens(self, df: DataFrame) -> DataFrame:
        """Features of rows that have `_tokens` already."""
        matrix = self.matrix

        @F.pandas_udf("array<double>")
        def summed(counts: pd.Series) -> pd.Series:
            return pd.Series(list(np.vstack(counts.to_numpy()) @ matrix) if len(counts) else [])

        counted = self.pipeline.stages[1].transform(df)
        return counted.withColumn(self.out, array_to_vector(summed(vector_to_array("_counts")))).drop("_counts")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path + "/pipeline")
        spark = SparkSession.active()
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(self.matrix)]
        spark.createDataFrame(rows, "i int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(
            path + "/matrix"
        )
        meta = spark.createDataFrame([(json.dumps({"out": self.out}),)], "value string")
        meta.coalesce(1).write.mode("overwrite").text(path + "/meta")

    @staticmethod
    def load(path: str) -> EmbeddingModel:
        spark = SparkSession.active()
        rows = spark.read.parquet(path + "/matrix").orderBy("i").collect()
        meta = json.loads(spark.read.text(path + "/meta").first()["value"])
        return EmbeddingModel(PipelineModel.load(path + "/pipeline"), np.array([r["vec"] for r in rows]), meta["out"])


def doc_embedding(
    df: DataFrame,
    vectors: DataFrame,
    dim: int,
    id_col: str = "id",
    tokens: Column | str = "tokens",
    max_bytes: int = VECTOR_BROADCAST_BYTES,
) -> DataFrame:
    """(id, vec): sum of the vectors of a text's tokens for a vector table of any size.

    Tokens without a vector add zero; a text without any gets a zero vector. The vector table is joined
    as a lookup; the sums combine inside the tasks that read the texts, so one row per text is shuffled.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    rows = df.select(id_col, F.posexplode_outer(tokens).alias("_pos", "token"))
    joined = lookup_join(
        rows, vectors.select("token", "vec"), "token", "left", max_bytes=max_bytes, spread=[id_col, "_pos"]
    )
    parts = [F.sum(F.coalesce(F.get("vec", F.lit(i)).cast("double"), F.lit(0.0))).alias(f"d{i}") for i in range(dim)]
    return joined.groupBy(id_col).agg(*parts).select(id_col, F.array(*[f"d{i}" for i in range(dim)]).alias("vec"))


def oov_rate(df: DataFrame, vectors: DataFrame, tokens: Column | str = "tokens") -> DataFrame:
    """Share of token occurrences that have no vector, so that a letter-case mismatch shows."""
    stats = token_stats(df, tokens)
    known = vectors.select("token", F.lit(1).alias("_k"))
    joined = stats.join(known, "token", "left")
    missing = F.sum(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0))
    return joined.agg(
        F.sum("n").alias("tokens"), missing.alias("missing"), F.try_divide(missing, F.sum("n")).alias("rate")
    )


@dataclass
class VectorRecipe:
    """Features that are numbers already: an array column becomes a vector."""

    col: str
    out: str = "features"

    @property
    def inputs(self) -> list[str]:
        return [self.col]

    def fit(self, df: DataFrame, weight: str | None = None) -> VectorRecipe:
        return self

    def fit_folds(self, df: DataFrame, fold: str, v: int) -> list[VectorRecipe]:
        return [self]  # nothing is fitted, so all folds share one feature column

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, array_to_vector(F.col(self.col).cast("array<double>")))


def transform_folds(fitted: Sequence[object], df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features of every fold's model as one column per fold, tokenizing each text once. A columnar file
    of the result lets each fold read its own column only."""
    names = []
    if hasattr(fitted[0], "after_tokens"):
        df = fitted[0].pipeline.stages[0].transform(df)
    for f, model in enumerate(fitted):
        df = model.after_tokens(df) if hasattr(model, "after_tokens") else model.transform(df)
        names.append(f"features_{f}")
        df = df.withColumnRenamed("features", names[-1])
    return df.drop("_tokens"), names
