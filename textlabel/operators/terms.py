"""TF-IDF with a vocabulary of any size: the dictionary is a table, and term counts meet it in a join.

`TfidfRecipe` keeps its terms as literals of a pipeline, which suits the hundred words of the usual recipe. Here
nothing is collected: a term's index comes from counts per hash bucket, and a text's features are two arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.functions.dictionaries import SNOWBALL_ENGLISH
from textlabel.functions.text import tokenize
from textlabel.operators.features import fit_vocabulary, idf
from textlabel.operators.joins import BROADCAST_BYTES
from textlabel.operators.recode import not_in
from textlabel.session import settle

# Buckets of the numbering; their totals are the only rows that meet in one task.
BUCKETS = 4096
# Cells that one task puts together by text.
CELLS_PER_TASK = 2_000_000


def term_counts(df: DataFrame, id_col: str, tokens: Column, *keep: str) -> DataFrame:
    """(id, …, token, k): how often each text has each of its tokens. Counted inside the row: the sorted tokens of a
    text change at the first of each token, and the distance to the next change is its count. No shuffle."""
    rows = df.select(id_col, *keep, F.array_sort(F.array_compact(tokens)).alias("_s"))
    new = F.transform("_s", lambda x, i: F.when((i == 0) | (x != F.get("_s", F.greatest(i - 1, F.lit(0)))), i).otherwise(F.lit(-1)))
    rows = rows.select(id_col, *keep, "_s", F.filter(new, lambda i: i >= 0).alias("_at"))
    ends = F.concat(F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), F.array(F.size("_s")))
    cells = F.zip_with("_at", ends, lambda a, b: F.struct(F.get("_s", a).alias("token"), (b - a).cast("long").alias("k")))
    cells = F.when(F.size("_at") > 0, cells).otherwise(F.array().cast("array<struct<token:string,k:bigint>>"))
    return rows.select(id_col, *keep, F.explode(cells).alias("c")).select(id_col, *keep, "c.token", "c.k")


def numbered(terms: DataFrame) -> DataFrame:
    """`terms` (distinct `token`) with `idx` 0, 1, …: by hash bucket, then token. Buckets are counted, their totals are
    summed over at most `BUCKETS` rows, and terms are ranked within their bucket, so nothing is sorted as a whole."""
    rows = terms.withColumn("_b", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)))
    totals = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("token"))
    return rows.withColumn("_r", rank).join(F.broadcast(starts), "_b").withColumn("idx", F.col("_start") + F.col("_r") - 1).drop("_b", "_r", "_start")


@dataclass
class TermDictionary:
    """A fitted vocabulary: a stored table (token, idx, n, df, idf) of `size` rows, fitted on `n_docs` texts. `stop` are
    tokens left out of it that may be in most texts."""

    table: DataFrame
    size: int
    n_docs: int
    stop: Sequence[str] = ()

    def _least_broadcast(self, limit: int) -> int | None:
        """The smallest power of two for which the terms of that many texts or more take at most `limit` bytes; None without any.
        The others are then rare: beyond `limit` bytes of terms at most twice as frequent are no hot keys."""
        power = F.floor(F.log2("df")).cast("int")
        width = F.octet_length("token").cast("long") + 64
        bins = sorted(self.table.groupBy(power.alias("p")).agg(F.sum(width).alias("b")).collect(), reverse=True)
        least, held = None, 0
        for p, size in bins:
            held += size
            if held > limit:
                return least
            least = 1 << p
        return least

    def cells(self, counts: DataFrame, id_col: str, max_bytes: int | None = None) -> DataFrame:
        """(id, features): each text's array of (idx, token, tf, tfidf) by idx. `tf` is the token's share of the text's
        tokens that are in the dictionary. Texts without any have no row.

        The most frequent terms are broadcast, as many as fit in `max_bytes` (64 MB by default), so only rare tokens are
        shuffled to meet the dictionary. Cells are then shuffled once, by text."""
        small = self.table.select("token", "idx", "df")
        rows = counts.select(id_col, "token", "k").filter(not_in("token", self.stop)) if self.stop else counts.select(id_col, "token", "k")
        least = self._least_broadcast(BROADCAST_BYTES if max_bytes is None else max_bytes)
        often = F.broadcast(small if least is None else small.filter(F.col("df") >= least))
        seldom = small if least is None else small.filter(F.col("df") < least)
        if least is None:
            met = rows.join(seldom, "token")
        else:
            met = rows.join(often, "token")
            if not seldom.isEmpty():
                rest = rows.join(often.select("token"), "token", "left_anti")
                met = met.unionByName(rest.join(seldom, "token"))
        tasks = max(counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // CELLS_PER_TASK))
        dealt = met.select(id_col, "idx", "token", "k", "df").repartition(tasks, id_col)
        rows = dealt.groupBy(id_col).agg(F.sum("k").alias("_all"), F.array_sort(F.collect_list(F.struct("idx", "token", "k", "df"))).alias("_f"))
        share = lambda c: c["k"].cast("double") / F.col("_all")
        weight = lambda c: share(c) * idf(self.n_docs, c["df"])
        cell = lambda c: F.struct(c["idx"].alias("idx"), c["token"].alias("token"), share(c).alias("tf"), weight(c).alias("tfidf"))
        return rows.select(id_col, F.transform("_f", cell).alias("features"))

    def vectors(self, ids: DataFrame, counts: DataFrame, id_col: str, out: str = "features") -> DataFrame:
        """`ids` with a sparse vector for each row; a text without a known token gets a zero vector, not a missing row."""
        size = self.size

        @F.udf(VectorUDT())
        def sparse(indices: list | None, values: list | None) -> SparseVector:
            return SparseVector(size, indices or [], values or [])

        arrays = self.cells(counts, id_col).select(
            id_col, F.transform("features", lambda c: c["idx"].cast("int")).alias("_i"), F.transform("features", lambda c: c["tfidf"]).alias("_v")
        )
        return ids.join(arrays, id_col, "left").withColumn(out, sparse("_i", "_v")).drop("_i", "_v")


@dataclass
class WideTfidf:
    """The steps of `TfidfRecipe` without an upper bound: tokens, frequency filter, stop words, TF-IDF.

    `counts` makes the (id, token, k) table once, in the shared folder; fits, folds and features all read that.
    Ids must be distinct and not NULL. A NULL text has no tokens; it still counts as a text.
    """

    id_col: str = "id"
    text: str = "text"
    lower: bool = True
    strip_punct: bool = True
    min_times: int = 5
    max_tokens: int | None = None
    stop: Sequence[str] = field(default_factory=lambda: SNOWBALL_ENGLISH)

    def counts(self, df: DataFrame, *keep: str) -> DataFrame:
        return settle(term_counts(df, self.id_col, tokenize(F.coalesce(self.text, F.lit("")), self.lower, self.strip_punct), *keep), "term-counts")

    def fit(self, counts: DataFrame, n_docs: int) -> TermDictionary:
        """The dictionary of all counted texts; `n_docs` is their number, those without tokens included."""
        stats = counts.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("df"))
        return self._fitted(stats, n_docs)

    def fit_folds(self, counts: DataFrame, fold: str, sizes: Sequence[int]) -> list[TermDictionary]:
        """One dictionary for each fold 0, 1, …, fitted on the other folds, whose sizes are given: counts per token and
        fold are summed side by side once, and a fold is left out by subtraction."""
        at = [F.col(fold) == f for f in range(len(sizes))]
        sums = [F.sum(F.when(a, F.col("k")).otherwise(0)).alias(f"n{f}") for f, a in enumerate(at)]
        sums += [F.sum(a.cast("long")).alias(f"df{f}") for f, a in enumerate(at)]
        side = settle(counts.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("df"), *sums), "fold-terms")
        parts = [side.select("token", (F.col("n") - F.col(f"n{f}")).alias("n"), (F.col("df") - F.col(f"df{f}")).alias("df")) for f in range(len(sizes))]
        return [self._fitted(p.filter("n > 0"), sum(sizes) - sizes[f]) for f, p in enumerate(parts)]

    def _fitted(self, stats: DataFrame, n_docs: int) -> TermDictionary:
        kept = fit_vocabulary(stats, self.min_times, self.max_tokens)
        if self.stop:
            kept = kept.filter(~F.col("token").isin(list(self.stop)))
        # Stored first: numbering reads its terms twice.
        table = settle(numbered(settle(kept, "kept-terms")).withColumn("idf", idf(n_docs, F.col("df"))), "terms")
        return TermDictionary(table, table.count(), n_docs, self.stop)
