"""Reproducible split, folds and bootstrap weights, all pure functions of (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.functions.hashing import hash_key, poisson_weight, unit
from textlabel.operators.joins import lookup_join


def _hashed(df: DataFrame, id_col: str, seed: object, digits: int) -> DataFrame:
    h = hash_key(seed, F.col(id_col))
    return df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))


def _bucket_ends(df: DataFrame, strata: str) -> DataFrame:
    """Rows per (stratum, hash bucket) with `_end`, the rows up to and with the bucket, and `_all`."""
    counts = df.groupBy(strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(strata).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("_end", F.sum("_n").over(run)).withColumn(
        "_all", F.sum("_n").over(W.partitionBy(strata))
    )


def stratified_split(
    df: DataFrame,
    id_col: str,
    strata: str,
    prop: float = 0.8,
    seed: object = 100,
    out: str = "part",
    digits: int = 4,
) -> DataFrame:
    """Mark exactly floor(prop * n) rows of each stratum as train and the others as test.

    Rows are ordered by md5(seed:id), then id. Counting rows per leading hash digits finds the one bucket
    in which a stratum's cut lies; only that sliver (1/65536 of the rows) is ranked. The cut, one row per
    stratum, then labels all rows in place: the data is read three times and never shuffled.
    """
    narrow = _hashed(df.select(id_col, strata), id_col, seed, digits)
    ends = _bucket_ends(narrow, strata)
    want = F.floor(F.col("_all") * F.lit(prop) + F.lit(1e-9)).cast("long")
    start = F.col("_end") - F.col("_n")
    edge = ends.withColumn("_want", want).filter((start < F.col("_want")) & (F.col("_want") <= F.col("_end")))
    edge = edge.select(strata, "_b", (F.col("_want") - start).alias("_rank"))
    sliver = lookup_join(narrow, edge, [strata, "_b"], null_safe=True)
    order = W.partitionBy(strata).orderBy("_h", id_col)
    cut = (
        sliver.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == F.col("_rank"))
        .select(strata, F.col("_h").alias("_cut_h"), F.col(id_col).alias("_cut_id"))
    )
    marked = lookup_join(df, cut, strata, "left", null_safe=True)
    h = hash_key(seed, F.col(id_col))
    train = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(id_col) <= F.col("_cut_id")))
    part = F.when(train, "train").otherwise("test")
    return marked.withColumn(out, part).drop("_cut_h", "_cut_id")


def stratified_folds(
    df: DataFrame,
    id_col: str,
    strata: str,
    v: int = 10,
    seed: object = 100,
    out: str = "fold",
    digits: int = 4,
) -> DataFrame:
    """Fold 0..v-1 of each row: its rank in the hash order of its stratum, modulo v.

    The rank is the rank inside a hash bucket plus the rows in earlier buckets, so a stratum with most of
    the rows is ranked by thousands of even tasks instead of one.
    """
    hashed = _hashed(df, id_col, seed, digits)
    ends = _bucket_ends(hashed.select(strata, "_b"), strata)
    before = ends.select(strata, "_b", (F.col("_end") - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(strata, "_b").orderBy("_h", id_col))
    ranked = lookup_join(hashed.withColumn("_in", inside), before, [strata, "_b"], null_safe=True)
    fold = F.pmod(F.col("_before") + F.col("_in") - 1, F.lit(v)).cast("long")
    return ranked.withColumn(out, fold).drop("_h", "_b", "_in", "_before")


def weight_of(replicate: Column | int, id_col: str, seed: object = None) -> Column:
    """Poisson(1) draw for one row in one replicate; 0 means out of bag."""
    rep = replicate if isinstance(replicate, Column) else F.lit(replicate)
    key = rep if seed is None else F.concat_ws(":", F.lit(str(seed)), rep.cast("string"))
    return poisson_weight(unit(key, F.col(id_col))).cast("long")


def replicate_ids(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))


def bootstrap_weights(
    df: DataFrame, id_col: str, replicates: int = 1000, seed: object = None, apparent: bool = False
) -> DataFrame:
    """(…, replicate, weight): how often each row is drawn in each replicate. Row-local.

    `apparent` adds replicate 0, the data as it is. Aggregate at once: the table has `replicates` rows
    per input row, but sums of it combine inside the tasks.
    """
    first = 0 if apparent else 1
    reps = df.withColumn("replicate", replicate_ids(first, replicates))
    weight = weight_of(F.col("replicate"), id_col, seed)
    if apparent:
        weight = F.when(F.col("replicate") == 0, F.lit(1).cast("long")).otherwise(weight)
    return reps.withColumn("weight", weight)
