"""Column expressions over arrays that compute each value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def _pair(left: Column, right: Column, shift: int) -> Column:
    """Hashes of what `left` begins at each position and `right` goes on with `shift` words later."""
    count = F.least(F.size(left), F.size(right) - shift)
    return F.when(
        count > 0,
        F.zip_with(F.slice(left, F.lit(1), count), F.slice(right, F.lit(shift + 1), count), lambda a, b: F.xxhash64(a, b)),
    ).otherwise(F.array().cast("array<bigint>"))


def window_hashes(word_hashes: Column, length: int) -> Column:
    """One hash per window of `length` words, by doubling: about log2(length) steps for all windows at once."""

    def double(blocks: Column, size: int, powers: list[tuple[int, Column]]) -> Column:
        if size * 2 > length:
            return extend(blocks, size, powers)
        return let(_pair(blocks, blocks, size), lambda twice: double(twice, size * 2, [*powers, (size, blocks)]))

    def extend(blocks: Column, size: int, powers: list[tuple[int, Column]]) -> Column:
        for step, hashes in reversed(powers):
            if size + step <= length:
                return let(_pair(blocks, hashes, size), lambda longer: extend(longer, size + step, powers))
        return blocks

    return double(word_hashes, 1, [])
