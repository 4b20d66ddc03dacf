"""Rounding and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0 (plain division raises in ANSI mode)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_numeric(df: DataFrame, places: int = 3, half_even: bool = True) -> DataFrame:
    """Round every floating or decimal column; half to even by default, as reports expect."""
    rounder = F.bround if half_even else F.round
    fractional = [n for n, t in df.dtypes if t in ("double", "float") or t.startswith("decimal")]
    return df.withColumns({n: rounder(F.col(f"`{n}`"), places) for n in fractional})
