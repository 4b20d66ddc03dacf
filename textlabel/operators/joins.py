"""Joins. A side is broadcast only after its size was measured; beyond the bound, keys are salted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


# Of a type whose size is not known here: more than any bound, so that it is never broadcast.
UNKNOWN_BYTES = 1 << 50


def _width(col: Column, kind: T.DataType) -> Column:
    """Bytes of one value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return (F.coalesce(F.octet_length(col), F.lit(0)) + 16).cast("long")
    if isinstance(kind, T.ArrayType):
        count = F.greatest(F.coalesce(F.size(col), F.lit(0)), F.lit(0)).cast("long")
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return 16 + 8 * count
        return 16 + F.coalesce(
            F.aggregate(col, F.lit(0).cast("long"), lambda acc, x: acc + _width(x, kind.elementType).cast("long")), F.lit(0)
        )
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(col), T.ArrayType(kind.keyType)) + _width(F.map_values(col), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_width(col[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)):
        return F.lit(16).cast("long")
    return F.lit(UNKNOWN_BYTES)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of `df` as counted by Spark, not as guessed by the planner."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(width.cast("long")).alias("b")).first()["b"] or 0


def _keyed(small: DataFrame, on: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_key{i}" for i in range(len(on))]
    return small.withColumnsRenamed(dict(zip(on, names))), names


def _same(on: Sequence[str], names: Sequence[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"`{a}`"), F.col(b)) for a, b in zip(on, names)]
    tests = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    spread: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join in which every key of `big` is spread over `salts` tasks and `small` is repeated for each.

    The salt is a hash of the `spread` columns of the row (all columns by default), so a retried task
    sends each row to where it went before. `how` may be inner, left, left_semi or left_anti.
    """
    spread = list(spread or big.columns)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(salts)).cast("int")
    small, names = _keyed(small, on)
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    test = (F.col("_salt") == F.col("_copy")) & _same(on, names, null_safe)
    return big.withColumn("_salt", salt).join(copies, test, how).drop("_salt", "_copy", *names)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_bytes: int | None = None,
    spread: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join a large table with a lookup table whose size is not known beforehand.

    The lookup is computed once and measured. Up to `max_bytes` it is broadcast, so the large side is
    not shuffled at all; beyond that the join is salted, so that one hot key does not end in one task.
    """
    on = [on] if isinstance(on, str) else list(on)
    small = small.persist()
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    if measured_bytes(small) <= limit:
        keyed, names = _keyed(small, on)
        return big.join(F.broadcast(keyed), _same(on, names, null_safe), how).drop(*names)
    return salted_join(big, small, on, how, spread=spread, null_safe=null_safe)


def attach_concepts(df: DataFrame, concepts: DataFrame, id_col: str = "id") -> DataFrame:
    """Concept strings back onto their records; NULL for a record without any."""
    return df.join(concepts, id_col, "left")


def error_analysis(
    pred: DataFrame,
    records: DataFrame,
    id_col: str = "id",
    cols: Sequence[str] | None = ("text",),
    truth: str = "truth",
    est: str = "pred",
) -> DataFrame:
    """Flag wrong predictions and add the named record columns (all of them when `cols` is None)."""
    wrong = F.when(F.col(truth) != F.col(est), 1).otherwise(0)
    keep = [c for c in (records.columns if cols is None else cols) if c != id_col and c not in pred.columns]
    return pred.withColumn("error", wrong).join(records.select(id_col, *keep), id_col, "left")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all column names both tables have."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, "left")


def cross(df: DataFrame, name: str, values: Sequence[object]) -> DataFrame:
    """Every row with every value of a short list; row-local, no Cartesian join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column that a table lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
