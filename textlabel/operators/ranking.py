"""Exact ranks and running totals that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.operators.joins import lookup_join

ROWS_PER_BUCKET = 500_000


def with_buckets(df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add `_bucket`, increasing with `order`, holding about `rows_per_bucket` rows each.

    The edges are approximate quantiles, which reach the driver as at most a few thousand numbers; they
    only decide how evenly work is spread, never the result. Small inputs get one bucket. NaN counts as
    larger than all numbers, with one bucket as with many.
    """
    rows = df.count()
    wanted = min(-(-rows // rows_per_bucket), 100_000)
    if wanted <= 1:
        return df.withColumn("_bucket", F.lit(0.0))
    edges = df.approxQuantile(order, [i / wanted for i in range(1, wanted)], 0.1 / wanted)
    splits = [float("-inf"), *sorted({e for e in edges if abs(e) != float("inf")}), float("inf")]
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0.0))
    # "keep" puts NaN into a bucket of its own after the last.
    return Bucketizer(splits=splits, inputCol=order, outputCol="_bucket", handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame,
    order: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cached: bool = False,
) -> DataFrame:
    """Running sum of each measure in ascending `order` within `by`, as `cum_<measure>`.

    `order` must be a DOUBLE that is unique within `by` (aggregate first: a score or value that a third
    of all rows share is then one row). Rows are summed inside order buckets, and the totals of earlier
    buckets, a tiny table, are added. Both steps use the keys (by, bucket), so the rows shuffle once.
    The rows are read twice, so they are persisted unless `cached` says that they or their parent are.
    """
    by = list(by)
    df = with_buckets(df if cached else df.persist(), order, rows_per_bucket)
    keys = [*by, "_bucket"]
    totals = df.groupBy(*keys).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = W.partitionBy(*by, F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.withColumns({f"_c_{m}": F.sum(m).over(inside) for m in measures})
    same = F.col("l._bucket") == F.col("o._bucket")
    for k in by:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"o.`{k}`"))
    joined = local.alias("l").join(offsets.alias("o"), same)
    plain = [c for c in df.columns if c != "_bucket"]
    return joined.select(
        *[F.col(f"l.`{c}`") for c in plain],
        *[(F.col(f"l._c_{m}") + F.col(f"o._o_{m}")).alias(f"cum_{m}") for m in measures],
    )


def quantiles_by_variable(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    type2: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(variable, q, n, missing): exact quantiles of several columns from one scan.

    The default interpolates between neighbours; `type2` takes the value, or the mean of the two values,
    at the jump. Works on counted distinct values and running totals, so no task sees a whole column.
    """
    cells = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    counts = long.groupBy("variable", "v").agg(F.count(F.lit(1)).alias("n")).persist()
    known = F.col("v").isNotNull()
    totals = counts.groupBy("variable").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("total"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("missing"),
    )
    runs = running_totals(counts.filter(known), "v", ["n"], ["variable"], rows_per_bucket, cached=True)
    ranked = lookup_join(runs, totals.select("variable", "total"), "variable")

    def at(rank: Column) -> Column:  # value at a 0-based rank
        return F.min(F.when(F.col("cum_n") > rank, F.col("v")))

    def quantile(p: float) -> Column:
        def target(n: Column) -> Column:
            return (n if type2 else n - 1) * F.lit(float(p))

        n = F.col("total")
        if type2:
            low, high = F.greatest(F.ceil(target(n)) - 1, F.lit(0)), F.least(F.floor(target(n)), n - 1)
            share = F.lit(0.5)
        else:
            low, high = F.floor(target(n)), F.ceil(target(n))
            share = target(F.max("total")) - F.floor(target(F.max("total")))
        return at(low) + (at(high) - at(low)) * share

    values = ranked.groupBy("variable").agg(F.array(*[quantile(p) for p in probs]).alias("q"))
    return totals.join(values, "variable", "left").select("variable", "q", F.col("total").alias("n"), "missing")


def quantile_table(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    type2: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row with `q` (array of exact quantiles), `n` (known values) and `missing`."""
    return quantiles_by_variable(df, [col], probs, type2, rows_per_bucket).drop("variable")


def top_n(df: DataFrame, by: str, col: str, n: int = 10) -> DataFrame:
    """The n largest rows per group, with ties. First the n largest distinct values per group are found
    by an aggregate that keeps n values per task, then rows at or above the last of them are kept, so a
    huge group is never sorted in one task.

    Ties count as rows: the cut is the value of the n-th row, not of the n-th distinct value.
    """
    counts = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(col).isNotNull())
    salt = F.pmod(F.xxhash64(F.col(col)), F.lit(64))
    inner = W.partitionBy(by, "_salt").orderBy(F.desc(col))
    near = counts.withColumn("_salt", salt).withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= n)
    outer = W.partitionBy(by).orderBy(F.desc(col)).rowsBetween(W.unboundedPreceding, -1)
    kept = near.withColumn("_above", F.coalesce(F.sum("_n").over(outer), F.lit(0))).filter(F.col("_above") < n)
    cut = kept.groupBy(by).agg(F.min(col).alias("_cut"))
    return lookup_join(df, cut, by, null_safe=True).filter(F.col(col) >= F.col("_cut")).drop("_cut")
