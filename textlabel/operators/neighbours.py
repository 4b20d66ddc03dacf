"""Exact k nearest neighbours without comparing everything with everything.

Training rows are grouped around pivots. The triangle inequality gives each query a distance within which
its neighbours must lie, and so the groups it has to visit. Groups are cut into blocks of bounded size, some
blocks make up a shelf, and the queries of a busy shelf are spread over several copies of it, so that no task
holds an unbounded group and a query is copied once a shelf at most. Within a task a matrix product tells which
rows can be near, and only their distances are worked out. (After the pivot-based nearest-neighbour join of Lu, Shen, Chen and Ooi, VLDB 2012.)
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabel.functions.hashing import hash_key

BLOCK_ROWS = 4_096
# Blocks of a shelf: how often a query is copied, against how many rows it meets that its own groups don't hold.
SHELF_BLOCKS = 8
MAX_PIVOTS = 512
# Cells of a matrix of distances, and the rows whose smallest distance is looked at first.
CELLS, STRIDE = 1_000_000, 32
PLACES = 9  # distances are compared at this many decimals, so summation order decides no tie


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, a few rows of a at a time."""
    step = max(1, 4_000_000 // max(1, b.size))
    parts = [
        np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(a), step)
    ]
    return np.round(np.vstack(parts), PLACES) if parts else np.zeros((0, len(b)))


def _every_distance(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(queries, points)
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(d, best, axis=1)


def _few_distances(queries: np.ndarray, points: np.ndarray, half: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`half`: half the squared lengths of `points`, which are at least k * STRIDE rows."""
    n, groups = len(queries), len(points) // STRIDE
    # Half the squared distance less half the squared length of the query.
    s = half - queries @ points.T
    least = s[:, : groups * STRIDE].reshape(n, STRIDE, groups).min(axis=1)
    # So many groups hold a row each within this, so that the k nearest are within it too.
    bound = np.partition(least, k - 1, axis=1)[:, k - 1]
    length = np.sqrt((queries * queries).sum(1))
    # What rounding of the product and of the distances can hide.
    scale = (length + np.sqrt(2 * half.max())) ** 2
    slack = 8 * (points.shape[1] + 8) * np.finfo(float).eps * scale + 2 * 10.0**-PLACES * np.sqrt(scale) + 10.0 ** (-2 * PLACES)
    bound = (bound + slack)[:, None]
    row, group = np.nonzero(least <= bound)
    many = np.bincount(row, minlength=n) > 4 * k + 64
    row, group = row[~many[row]], group[~many[row]]
    col = group[:, None] + groups * np.arange(STRIDE)
    near = s[row[:, None], col] <= bound[row]
    at, place = np.nonzero(near)
    row, col = row[at], col[at, place]
    if groups * STRIDE < len(points):
        rest_row, rest = np.nonzero((s[:, groups * STRIDE :] <= bound) & ~many[:, None])
        row, col = np.concatenate([row, rest_row]), np.concatenate([col, rest + groups * STRIDE])
    step = max(1, 4 * CELLS // points.shape[1])
    parts = [np.sqrt(((queries[row[i : i + step]] - points[col[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(row), step)]
    dist = np.round(np.concatenate([np.empty(0), *parts]), PLACES)
    order = np.lexsort([col, dist, row])
    held = np.bincount(row, minlength=n)
    starts = np.cumsum(held) - held
    best, near_by = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    few = np.flatnonzero(~many)
    take = order[starts[few][:, None] + np.arange(k)] if len(few) else np.empty((0, k), dtype=np.int64)
    best[few], near_by[few] = col[take], dist[take]
    if many.any():  # copies, most of all: no few rows are the nearest
        best[many], near_by[many] = _every_distance(queries[many], points, k)
    return best, near_by


def closest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (query, rank) of the k nearest points, of equal distances the first."""
    k, step = min(k, len(points)), max(1, CELLS // max(1, len(points)))
    with np.errstate(over="ignore", invalid="ignore"):
        half = (points * points).sum(axis=1) / 2
        plain = len(points) < k * STRIDE or not k or not np.isfinite(half).all() or not np.isfinite((queries * queries).sum())
    parts = [
        _every_distance(queries[i : i + step], points, k) if plain else _few_distances(queries[i : i + step], points, half, k)
        for i in range(0, len(queries), step)
    ]
    if not parts:
        return np.zeros((0, k), dtype=np.int64), np.zeros((0, k))
    return np.vstack([b for b, _ in parts]), np.vstack([d for _, d in parts])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype="float64") for v in vectors])


def _nearest_pivot(pivots: np.ndarray) -> Column:
    @F.pandas_udf("struct<cell:int,dist:double>")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(vec), pivots) if len(vec) else np.zeros((0, len(pivots)))
        cell = d.argmin(axis=1) if len(vec) else np.zeros(0, dtype=int)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": d[np.arange(len(vec)), cell]})

    return nearest(F.col("vec"))


def _shelves_to_visit(pivots: np.ndarray, stats: pd.DataFrame, k: int, shelves_of: np.ndarray) -> Column:
    """`shelves_of` says which shelves (column) hold rows of a cell (row)."""
    radius, inner = stats["radius"].to_numpy(), stats["inner"].to_numpy()
    n, n_inner = stats["n"].to_numpy(), stats["n_inner"].to_numpy()

    @F.pandas_udf("array<int>")
    def visit(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        d = _distances(_matrix(vec), pivots)
        # Every cell promises n_inner points within d + inner and the rest within d + radius.
        reach = np.hstack([d + inner, d + radius])
        held = np.tile(np.hstack([n_inner, n - n_inner]), (len(d), 1))
        order = reach.argsort(axis=1)
        filled = np.take_along_axis(held, order, axis=1).cumsum(axis=1)
        at = (filled >= min(k, n.sum())).argmax(axis=1)
        bound = np.take_along_axis(reach, order, axis=1)[np.arange(len(d)), at]
        inside = (d - radius) <= bound[:, None] + 1e-6
        wanted = (inside & (n > 0)).astype("float32") @ shelves_of
        return pd.Series([np.flatnonzero(row).astype("int32") for row in wanted])

    return visit(F.col("vec"))


def shelve(sizes: Sequence[int], block_rows: int) -> list[tuple[int, int, int, int]]:
    """(group, block, blocks, shelf): groups cut into blocks of some `block_rows` rows, and shelves of at most SHELF_BLOCKS times as
    many rows in the order of the groups."""
    out: list[tuple[int, int, int, int]] = []
    shelf, filled = 0, 0.0
    for group, n in enumerate(sizes):
        blocks = max(1, -(-n // block_rows))
        for block in range(blocks):
            filled += n / blocks
            if out and filled > SHELF_BLOCKS * block_rows:
                shelf, filled = shelf + 1, n / blocks
            out.append((group, block, blocks, shelf))
    return out


def shelf_copies(load: Mapping[int, int], shelves: int, block_rows: int, cores: int) -> dict[int, int]:
    """As few copies of each shelf as hold its queries, but enough tasks for the cores."""
    tasks = -(-2 * cores // shelves)
    return {s: max(1, -(-load.get(s, 0) // (SHELF_BLOCKS * block_rows)), min(tasks, -(-load.get(s, 0) // block_rows))) for s in range(shelves)}


def _block_search(k: int):
    def search(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "train_id", "label", "dist"]
        if queries.empty or train.empty:
            return pd.DataFrame({c: [] for c in cols})
        ids = train["train_id"].to_numpy()
        rank = np.argsort(ids, kind="stable")  # so that equal distances go by id
        ids, labels = ids[rank], train["label"].to_numpy()[rank]
        best, dist = closest(_matrix(queries["vec"]), _matrix(train["vec"])[rank], k)
        rows = np.repeat(queries["query_id"].to_numpy(), best.shape[1])
        return pd.DataFrame(
            {
                "query_id": rows,
                "train_id": ids[best].ravel(),
                "label": labels[best].ravel(),
                "dist": dist.ravel(),
            }
        )

    return search


def knn(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    id_col: str = "id",
    vec: str = "vec",
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
    exclude_self: bool = False,
) -> DataFrame:
    """(query_id, rank, train_id, label, dist): the k nearest training rows of each query, ties by id.

    `exclude_self` leaves out the training row with the query's own id.
    """
    k_wide = k + 1 if exclude_self else k
    as_array = F.col(vec).cast("array<double>").alias("vec")
    q = queries.select(F.col(id_col).alias("query_id"), as_array)
    t = train.select(F.col(id_col).alias("train_id"), as_array, F.col(label).cast("double").alias("label"))

    count = t.count()
    wanted = min(MAX_PIVOTS, max(1, -(-count // block_rows)))
    chosen = t.orderBy(hash_key("pivot", F.col("train_id"))).limit(wanted).select("vec").collect()
    if not chosen:
        raise ValueError("no training rows")
    pivots = np.array([r["vec"] for r in chosen])

    placed = t.withColumn("_c", _nearest_pivot(pivots)).select("train_id", "vec", "label", "_c.cell", "_c.dist").persist()
    # One row per pivot reaches the driver.
    inner = placed.groupBy("cell").agg(F.percentile_approx("dist", 0.05).alias("inner"))
    stats = (
        placed.join(F.broadcast(inner), "cell")
        .groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("dist").alias("radius"),
            F.max("inner").alias("inner"),
            F.sum((F.col("dist") <= F.col("inner")).cast("long")).alias("n_inner"),
        )
        .toPandas()
        .set_index("cell")
        .reindex(range(len(pivots)))
        .fillna(0)
    )
    spark = queries.sparkSession
    shelves = shelve(stats["n"].astype(int).tolist(), block_rows)
    shelves_of = np.zeros((len(pivots), shelves[-1][-1] + 1), dtype="float32")
    for cell, _, _, shelf in shelves:
        shelves_of[cell, shelf] = 1

    routed = q.withColumn("shelves", _shelves_to_visit(pivots, stats, k_wide, shelves_of)).persist()
    asked = routed.select("query_id", "vec", F.explode("shelves").alias("shelf"))
    load = {r["shelf"]: r["n"] for r in asked.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
    copies = shelf_copies(load, shelves_of.shape[1], block_rows, spark.sparkContext.defaultParallelism)
    layout = F.broadcast(spark.createDataFrame([(*row, copies[row[-1]]) for row in shelves], "cell int, block int, blocks int, shelf int, copies int"))
    spread = F.broadcast(spark.createDataFrame(list(copies.items()), "shelf int, copies int"))
    left = asked.join(spread, "shelf").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int"))
    mine = (layout["cell"] == placed["cell"]) & (layout["block"] == F.pmod(F.xxhash64("train_id"), layout["blocks"]))
    right = placed.join(layout, mine).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keys = ["shelf", "copy"]
    id_type, train_type = q.schema["query_id"].dataType, t.schema["train_id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("train_id", train_type),
            T.StructField("label", T.DoubleType()),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    found = (
        left.select(*keys, "query_id", "vec")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "train_id", "vec", "label").groupBy(*keys))
        .applyInPandas(_block_search(k_wide), schema)
    )
    if exclude_self:
        found = found.filter(F.col("query_id") != F.col("train_id"))
    order = W.partitionBy("query_id").orderBy("dist", "train_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "train_id", "label", "dist")


KERNELS = ["uniform", "inverse", "triangular", "gaussian"]


def knn_vote(neighbours: DataFrame, k: int, kernel: str = "uniform") -> DataFrame:
    """(query_id, p1) from k + 1 ranked neighbours: share of the weight that sits on label 1.

    Distances are divided by that of neighbour k + 1 (of the last one when there is none), as weighted
    nearest-neighbour voting does, so that kernels see numbers between 0 and 1.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}")
    scale = F.max("dist").over(W.partitionBy("query_id"))
    rel = F.when(F.col("_s") > 0, F.col("dist") / F.col("_s")).otherwise(F.lit(0.0))
    weight = {
        "uniform": F.lit(1.0),
        "inverse": F.lit(1.0) / F.greatest(rel, F.lit(1e-6)),
        "triangular": F.greatest(F.lit(1.0) - rel, F.lit(1e-6)),
        "gaussian": F.exp(-rel * rel / 2),
    }[kernel]
    scored = neighbours.withColumn("_s", scale).filter(F.col("rank") <= k).withColumn("_w", weight)
    on_one = F.sum(F.when(F.col("label") == 1, F.col("_w")).otherwise(0.0))
    return scored.groupBy("query_id").agg((on_one / F.sum("_w")).alias("p1"))


def vote_in_place(train: list[tuple], k: int, kernel: str = "uniform") -> Callable[[Column], Column]:
    """The share of `knn_vote` for a vector column, given all training rows (id, vector, label) of a bounded table.

    The rows travel to the tasks once; queries are answered in batches where they lie, without ids, joins or shuffles.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}")
    if not train:
        raise ValueError("no training rows")
    rows = sorted(train, key=lambda r: r[0])  # so that equal distances go by id
    points, ones = np.array([r[1] for r in rows], dtype="float64"), np.array([r[2] == 1 for r in rows])
    step = max(1, 2_000_000 // len(points))

    def votes(vectors: np.ndarray) -> np.ndarray:
        best, near = closest(vectors, points, k + 1)
        scale = near.max(axis=1, keepdims=True)
        rel = np.divide(near, scale, out=np.zeros_like(near), where=scale > 0)[:, :k]
        weight = {
            "uniform": np.ones_like(rel),
            "inverse": 1.0 / np.maximum(rel, 1e-6),
            "triangular": np.maximum(1.0 - rel, 1e-6),
            "gaussian": np.exp(-rel * rel / 2),
        }[kernel]
        return (weight * ones[best[:, :k]]).sum(axis=1) / weight.sum(axis=1)

    @F.pandas_udf("double")
    def share(vec: pd.Series) -> pd.Series:
        all_rows = _matrix(vec)
        parts = [votes(all_rows[i : i + step]) for i in range(0, len(all_rows), step)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return share


__all__ = ["BLOCK_ROWS", "KERNELS", "knn", "knn_vote", "vote_in_place"]
