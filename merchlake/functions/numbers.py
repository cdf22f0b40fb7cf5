"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, low: float, high: float) -> Column:
    """`value` brought linearly from low..high to 0..1 and clamped; null for null."""
    share = (value.cast("double") - F.lit(float(low))) / F.lit(float(high - low))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def mean_present(*parts: Column) -> Column:
    """The mean of those parts that are not null; 0 if all are."""
    present = F.filter(F.array(*parts), lambda p: p.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, p: a + p)
    return F.when(F.size(present) > 0, total / F.size(present)).otherwise(F.lit(0.0))


def round_half_up(value: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(value + 0.5)


def price_score(price: Column) -> Column:
    """1 for cheap to 0 for dear, on a logarithmic scale from 10 ** 3.5 to 10 ** 5.5."""
    return F.lit(1.0) - bucket(F.log10(F.greatest(price, F.lit(1000.0))), 3.5, 5.5)


def positive(value: Column) -> Column:
    """The value, or null where it is 0: a zero counts as missing."""
    return F.when(value != 0, value)
