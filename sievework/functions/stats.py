"""Robust statistics over arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_mean(values: Column, share: int = 5) -> Column:
    """Mean without the ``max(1, n div share)`` least and greatest values, if more than those remain.

    Nulls are left out first; an empty array gives null.
    """
    xs = F.array_sort(F.array_compact(values))
    n = F.size(xs)
    cut = F.greatest(F.lit(1), F.floor(n / F.lit(share)).cast("int"))
    kept = F.when(n > 2 * cut, F.slice(xs, cut + 1, n - 2 * cut)).otherwise(xs)
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def upper_median(values: Column) -> Column:
    """The value at index ``n div 2`` of the sorted array: the upper one of two middles."""
    xs = F.array_sort(F.array_compact(values))
    return F.get(xs, F.floor(F.size(xs) / F.lit(2)).cast("int"))
