"""Approximate nearest neighbours for large tables in many dimensions: inverted lists with residual codes.

Where distances are alike, as in 64 and more dimensions, the triangle inequality of `neighbours.knn` prunes little
and a search comes near all pairs. Here every row is filed under its nearest centroid, a query reads only the lists
of its nearest centroids, rows are compared by one byte a dimension of what the centroid leaves over, and the best
candidates are compared again by their own vectors. How many lists are read is chosen by recall that is measured
against the exact search; `neighbours.knn` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.functions.hashing import hash_key
from textlabel.operators.neighbours import BLOCK_ROWS, PLACES, knn, shelf_copies, shelve
from textlabel.session import settle

MAX_LISTS = 4_096
# Bounds of the sample that centroids and code ranges are fitted on, and of the queries that recall is measured with.
SAMPLE_ROWS = 65_536
RECALL_QUERIES = 200
# Candidates that are compared by their own vectors, for each neighbour asked for.
REFINE = 8
# A distance that is no number comes after all others, and before rows that are not read.
LAST = np.finfo(float).max


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype="float64") for v in vectors])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; good enough to choose, not to report."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T


def _chunks(vectors: pd.Series, width: int, each: Callable[[np.ndarray], np.ndarray]) -> list:
    """`each` over some rows at a time, so that no matrix has more than some millions of cells."""
    step = max(1, 4_000_000 // max(1, width))
    return [row for i in range(0, len(vectors), step) for row in each(_rows(vectors[i : i + step]))]


@dataclass
class InvertedLists:
    """Centroids, ranges of the residuals per dimension, and how many lists a query reads (`recall` is what was measured)."""

    centroids: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int
    recall: float

    @classmethod
    def fit(
        cls, train: DataFrame, k: int = 10, target: float = 0.95, lists: int | None = None, id_col: str = "id", vec: str = "vec", seed: int = 1
    ) -> InvertedLists:
        """Centroids and code ranges from the SAMPLE_ROWS rows with the smallest hash of their id, every row if there are fewer.

        `lists` is by default twice the square root of the number of rows, at most MAX_LISTS. For RECALL_QUERIES rows, chosen by
        another hash, the exact k nearest rows are found, and the rank of the list of each among the lists nearest to the query: `probes` is
        the smallest number that reaches `target` of them. Rows with a NULL id or vector are left out.
        """
        rows = train.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).dropna()
        count = rows.count()
        if not count:
            raise ValueError("no training rows")
        lists = lists or max(1, min(MAX_LISTS, int(2 * count**0.5)))
        sample = settle(rows.orderBy(hash_key("lists", F.col("id"))).limit(SAMPLE_ROWS), "list-sample")
        points = sample.select(array_to_vector("vec").alias("features"))
        fitted = KMeans(k=min(lists, min(count, SAMPLE_ROWS)), seed=seed, maxIter=10).fit(points)
        centroids = np.array(fitted.clusterCenters())
        out = cls(centroids, np.zeros(centroids.shape[1]), np.ones(centroids.shape[1]), len(centroids), 1.0)
        edges = sample.select(F.posexplode(out._residual("vec")).alias("dim", "x")).groupBy("dim").agg(F.min("x"), F.max("x"))
        found = np.array(sorted(map(tuple, edges.collect())))  # one row for each dimension
        out.low = found[:, 1]
        out.step = np.maximum((found[:, 2] - found[:, 1]) / 255, 1e-12)
        asked = settle(rows.orderBy(hash_key("recall", F.col("id"))).limit(RECALL_QUERIES), "recall-queries")
        out.probes, out.recall = out._measure(asked, rows, k, target)
        return out

    def _measure(self, asked: DataFrame, rows: DataFrame, k: int, target: float) -> tuple[int, float]:
        near = knn(asked, rows.withColumn("label", F.lit(0.0)), k, exclude_self=True).select(F.col("query_id").alias("id"), "train_id")
        mates = rows.withColumnRenamed("id", "train_id").select("train_id", self._nearest(F.col("vec"), 1)[0].alias("list"))
        ranked = asked.select("id", self._nearest(F.col("vec"), len(self.centroids)).alias("order"))
        ranks = near.join(mates, "train_id").join(ranked, "id").select(F.array_position("order", F.col("list")).alias("r"))
        seen = sorted(r["r"] for r in ranks.collect())  # at most RECALL_QUERIES times k numbers
        if not seen:
            return len(self.centroids), 1.0
        probes = int(seen[min(len(seen) - 1, max(0, int(np.ceil(target * len(seen))) - 1))])
        return probes, sum(r <= probes for r in seen) / len(seen)

    def _nearest(self, vec: Column, n: int) -> Column:
        centroids = self.centroids

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            def each(m: np.ndarray) -> np.ndarray:
                return np.argsort(_squares(m, centroids), axis=1, kind="stable")[:, :n].astype("int32")

            return pd.Series(_chunks(v, len(centroids), each), dtype=object)

        return nearest(vec)

    def _residual(self, vec: str) -> Column:
        centroids = self.centroids

        @F.pandas_udf("array<double>")
        def residual(v: pd.Series) -> pd.Series:
            return pd.Series(_chunks(v, len(centroids), lambda m: m - centroids[_squares(m, centroids).argmin(1)]), dtype=object)

        return residual(F.col(vec))

    def file(self, rows: DataFrame) -> DataFrame:
        """(train_id, list, code): every row under its nearest centroid with one byte a dimension."""
        centroids, low, step = self.centroids, self.low, self.step

        @F.pandas_udf("struct<list:int,code:binary>")
        def filed(v: pd.Series) -> pd.DataFrame:
            def each(m: np.ndarray) -> list:
                at = _squares(m, centroids).argmin(1)
                code = np.clip(np.rint((m - centroids[at] - low) / step), 0, 255).astype(np.uint8)
                return list(zip(at.tolist(), map(bytes, code)))

            return pd.DataFrame(_chunks(v, len(centroids), each), columns=["list", "code"]).astype({"list": "int32"})

        return rows.withColumn("_f", filed("vec")).select(F.col("id").alias("train_id"), "_f.list", "_f.code")

    def search(
        self, queries: DataFrame, train: DataFrame, k: int, id_col: str = "id", vec: str = "vec",
        exclude_self: bool = False, probes: int | None = None, block_rows: int = BLOCK_ROWS,
    ) -> DataFrame:
        """(query_id, rank, train_id, dist): k near rows of each query, exact distances, ties by id.

        All rows are filed; a long list is cut into blocks, some blocks make up a shelf, and the queries of a busy shelf are spread over
        copies of it, so a group never grows with the table. A query goes to a shelf once, with its lists there. Each shelf keeps the
        REFINE * k rows that its codes show nearest; the best of all shelves of a query are compared by their vectors. With `probes` as many as there are lists every row is compared by its code. `exclude_self` leaves out the row with the
        query's own id. Rows with a NULL id or vector neither ask nor are found; ids should be unique.
        """
        k_wide = k + 1 if exclude_self else k
        wide = REFINE * k_wide
        q, t = (
            d.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).dropna() for d in (queries, train)
        )
        filed = settle(self.file(t), "inverted-lists")
        held = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        shelves = shelve([held.get(c, 0) for c in range(len(self.centroids))], block_rows)
        member = np.zeros((shelves[-1][-1] + 1, len(self.centroids)), dtype=bool)
        for list_, _, _, shelf in shelves:
            member[shelf, list_] = list_ in held

        @F.pandas_udf("array<int>")
        def shelves_of(lists: pd.Series) -> pd.Series:
            if not len(lists):
                return pd.Series([], dtype=object)
            wanted = np.stack(lists.tolist())
            met = np.stack([has[wanted].any(axis=1) for has in member], axis=1)
            return pd.Series([np.flatnonzero(row).astype("int32") for row in met])

        routed = q.select(F.col("id").alias("query_id"), "vec", self._nearest(F.col("vec"), probes or self.probes).alias("lists"))
        routed = settle(settle(routed, "query-lists").withColumn("shelves", shelves_of("lists")), "routed-queries")
        asked = routed.select("query_id", "vec", "lists", F.explode("shelves").alias("shelf"))
        load = {r["shelf"]: r["n"] for r in asked.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
        spark = queries.sparkSession
        copies = shelf_copies(load, len(member), block_rows, spark.sparkContext.defaultParallelism)
        layout = F.broadcast(spark.createDataFrame([(*row, copies[row[-1]]) for row in shelves], "list int, block int, blocks int, shelf int, copies int"))
        ends = [(s, int(has.nonzero()[0].min(initial=len(self.centroids))), int(has.nonzero()[0].max(initial=-1)), copies[s]) for s, has in enumerate(member)]
        spread = F.broadcast(spark.createDataFrame(ends, "shelf int, first int, last int, copies int"))
        here = F.filter("lists", lambda c: c.between(F.col("first"), F.col("last")))
        left = asked.join(spread, "shelf").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int")).withColumn("lists", here)
        mine = (layout["list"] == filed["list"]) & (layout["block"] == F.pmod(F.xxhash64("train_id"), layout["blocks"]))
        right = filed.join(layout, mine).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("shelf", "copy", filed["list"], "train_id", "code")
        keys = ["shelf", "copy"]
        centroids, low, step = self.centroids, self.low, self.step

        def compare(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or rows.empty:
                return pd.DataFrame({"query_id": [], "train_id": [], "near": []})
            rows = rows.sort_values(["list", "train_id"], kind="stable")
            ids, at = rows["train_id"].to_numpy(), rows["list"].to_numpy()
            place = np.empty(len(ids), dtype=np.int64)
            place[np.argsort(ids, kind="stable")] = np.arange(len(ids))  # so that equal codes go by id
            points = centroids[at] + low + np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1) * step
            lists, starts = np.unique(at, return_index=True)
            stops, out = np.append(starts[1:], len(at)), []
            some = max(1, 4_000_000 // len(rows))
            for i in range(0, len(asked), some):
                part = asked[i : i + some]
                vectors, d = _rows(part["vec"]), np.full((len(part), len(rows)), np.inf)
                odd = not (np.isfinite(vectors).all() and np.isfinite(points).all())
                owner = np.repeat(np.arange(len(part)), part["lists"].map(len))
                reads = np.concatenate(part["lists"].tolist())
                for c, start, stop in zip(lists, starts, stops):
                    asks = owner[reads == c]
                    if len(asks):
                        squares = np.round(_squares(vectors[asks], points[start:stop]), PLACES)
                        d[asks, start:stop] = np.nan_to_num(squares, nan=LAST, posinf=LAST) if odd else squares
                bound = np.partition(d, wide - 1, axis=1)[:, wide - 1] if wide < d.shape[1] else np.full(len(d), np.inf)
                row, col = np.nonzero((d <= bound[:, None]) & (d < np.inf))
                near = d[row, col]
                order = np.lexsort([place[col], near, row])
                row, col, near = row[order], col[order], near[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < wide
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row[first]], "train_id": ids[col[first]], "near": near[first]}))
            return pd.concat(out)

        kind = t.schema["id"].dataType.simpleString()
        found = (
            left.select(*keys, "query_id", "vec", "lists").groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInPandas(compare, f"query_id {q.schema['id'].dataType.simpleString()}, train_id {kind}, near double")
        )
        if exclude_self:
            found = found.filter(F.col("query_id") != F.col("train_id"))
        best = F.row_number().over(W.partitionBy("query_id").orderBy("near", "train_id"))
        some = found.withColumn("_r", best).filter(F.col("_r") <= wide).select("query_id", "train_id")
        both = some.join(q.select(F.col("id").alias("query_id"), F.col("vec").alias("x")), "query_id")
        both = both.join(t.select(F.col("id").alias("train_id"), F.col("vec").alias("y")), "train_id")
        squares = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, s: acc + s)
        dist = both.select("query_id", "train_id", F.round(F.sqrt(squares), PLACES).alias("dist"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "train_id")).cast("long")
        return dist.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "train_id", "dist")
