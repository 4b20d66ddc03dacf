"""Column names that do not meet those of the caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores after it as it takes to be new in `df` (letter case does not tell names apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name}`")
