"""Bounded samples in hash order, of which no task and no driver sees more than a few times their size.

The smallest ``n`` hashes are found in two steps: hashes are counted by their number of leading zeros, which gives a bound
below which there are about as many as wanted; then only what lies below it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hashes are ordered as signed numbers.
LEAST = -(1 << 63)
# How many more than wanted are let through, as different hashes are counted by a sketch.
MARGIN = 1.3


def hash_bound(df: DataFrame, h: str, n: int) -> int | None:
    """A hash below which there are about ``n`` to 3 ``n`` different ones in column ``h``; None if there are no more."""
    zeros = 64 - F.length(F.bin(F.col(h).bitwiseXOR(F.lit(LEAST))))
    counts = dict(df.where(F.col(h).isNotNull()).groupBy(zeros.alias("z")).agg(F.approx_count_distinct(h, 0.05)).collect())  # at most 64 rows
    total = 0
    for z in sorted(counts, reverse=True):
        total += counts[z]
        if total >= MARGIN * n:
            return LEAST + (1 << (64 - z)) if z else None
    return None


def below(df: DataFrame, h: str, n: int) -> DataFrame:
    """The rows whose hashes are among about the ``n`` to 3 ``n`` smallest different ones; ``df`` is read twice."""
    bound = hash_bound(df, h, n)
    return df if bound is None else df.where(F.col(h) < bound)


def smallest(df: DataFrame, key: str, n: int, by: Column | None = None) -> DataFrame:
    """The ``n`` different non-null values of ``key`` that come first in the order of their hash."""
    hashed = df.select((F.xxhash64(key) if by is None else by).alias("_h"), key).where(F.col(key).isNotNull())
    return below(hashed, "_h", n).distinct().orderBy("_h", key).limit(n).select(key)
