"""Randomness as a pure function of (seed, key), so that no rerun, retry or repartitioning changes it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: object, key: Column) -> Column:
    """md5 of "seed:key" as 32 hex digits; its text order is the random order."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def unit(seed: object, key: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of the hash."""
    digits = F.substring(hash_key(seed, key), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def _poisson_cuts() -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean one, as far as the 32 bits of `unit` reach."""
    cuts, term, total = [], math.exp(-1.0), 0.0
    while total < 1.0 - 2.0**-32:
        total += term
        term /= len(cuts) + 1
        cuts.append(total)
    return cuts


POISSON_CUTS = _poisson_cuts()


def poisson_weight(u: Column) -> Column:
    """How often a row is drawn in one bootstrap replicate, from a number in [0, 1)."""
    weight = F.lit(len(POISSON_CUTS))
    for k in range(len(POISSON_CUTS) - 1, -1, -1):
        weight = F.when(u < F.lit(POISSON_CUTS[k]), F.lit(k)).otherwise(weight)
    return weight
