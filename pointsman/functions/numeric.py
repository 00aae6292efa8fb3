"""Numeric columns: cleaning, entropy, level moments, relative gains and utilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
ZERO = 0.0


def clean_numeric(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), ZERO).otherwise(c)


def is_finite(c: Column) -> Column:
    return F.coalesce(~(F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def entropy_norm(p: Column) -> Column:
    """-sum p ln p over positive p, divided by ln of the number of levels, zeros included."""
    raw = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + F.when(v > 0, -v * F.log(v)).otherwise(0.0))
    return raw / F.when(F.size(p) > 1, F.log(F.size(p).cast("double"))).otherwise(1.0)


def binary_entropy(p: Column) -> Column:
    def term(x: Column) -> Column:
        return F.when(x > 0, -x * F.log(x)).when(x.isNotNull(), 0.0)

    return (term(p) + term(1.0 - p)) / F.log(F.lit(2.0))


def moment(levels: Column, p: Column, power: int) -> Column:
    terms = F.zip_with(levels, p, lambda x, w: (x if power == 1 else x * x) * w)
    return total(terms)


def spread(levels: Column, p: Column) -> Column:
    mean = moment(levels, p, 1)
    return F.sqrt(F.greatest(F.lit(0.0), moment(levels, p, 2) - mean * mean))


def half_even(c: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.rint(c).cast("long")


def clamped_share(n: Column, ratio: float) -> Column:
    """Half-even share of n, at least 1 and at most n - 1; 1 when n is 1."""
    k = F.greatest(F.lit(1), F.least(n - 1, half_even(n * F.lit(float(ratio)))))
    return F.when(n > 1, k).otherwise(F.lit(1)).cast("long")


def safe_relative(a: Column, b: Column, one_minus: bool = False) -> Column:
    """a/b - 1, or 1 - a/b; null when b is as good as zero."""
    ratio = F.when(F.abs(b) > TINY, a / b)
    return 1.0 - ratio if one_minus else ratio - 1.0


def utility(quality: Column, cost: Column, lam: Column) -> Column:
    return (1.0 - lam) * quality - lam * cost


def minmax(c: Column, low: Column, high: Column, floor: float | None = None) -> Column:
    """(c - low) / range; a zero range counts as 1, or as `floor` when given."""
    width = high - low
    if floor is None:
        return (c - low) / F.when(high > low, width).otherwise(1.0)
    return (c - low) / F.greatest(width, F.lit(floor))
