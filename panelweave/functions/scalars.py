"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Result labels.
TIERS = ("high", "medium", "low")
INCREASE, DECREASE, UNDECIDED = "increase", "decrease", "not enough data to detect"


def blank_as_null(name: str, trim: bool = False) -> Column:
    """Text column ``name`` with the empty string as NULL. Zeros and spaces are data."""
    text = F.col(f"`{name}`")
    return F.nullif(F.trim(text) if trim else text, F.lit(""))


def zero_as_null(value: Column) -> Column:
    """Number ``value`` with zero as NULL."""
    return F.nullif(value, F.lit(0))


def missing_count(name: str, dtype: T.DataType, zero_is_missing: bool = False) -> Column:
    """Number of rows where ``name`` is NULL or, for text, empty."""
    value = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        value = F.nullif(value, F.lit(""))
    elif zero_is_missing and isinstance(dtype, T.NumericType):
        value = zero_as_null(value)
    return F.count(F.lit(1)) - F.count(value)


def round_half_up(value: Column, digits: int) -> Column:
    """The double ``value`` rounded once, half away from zero, as the decimal it prints as."""
    return F.round(value.cast("double"), digits)


def store_as(value: Column, dtype: T.DataType) -> Column:
    """``value`` as it reads back from a column of type ``dtype``; out of range gives NULL."""
    return value.try_cast(dtype)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(num, den)


def in_range(value: Column, lo: float, hi: float) -> Column:
    """``value`` in [lo, hi], exactly: the bounds are given, not computed."""
    return value.cast("double").between(float(lo), float(hi))


def tier_label(cumulative: Column, cuts: Sequence[float]) -> Column:
    """``high`` below the first cut, ``medium`` below an optional second one, else ``low``."""
    if not 1 <= len(cuts) <= 2:
        raise ValueError("one or two cuts are needed")
    label = F.when(cumulative < F.lit(cuts[0]), TIERS[0])
    if len(cuts) == 2:
        label = label.when(cumulative < F.lit(cuts[1]), TIERS[1])
    return label.otherwise(TIERS[2])


# Sums of products no larger than this share of the terms they are made of are rounding noise.
NOISE = 1e-13


def trend_label(slope: Column, products: Column, terms: Column) -> Column:
    """Direction of ``slope``, whose sign is that of the sum ``products``.

    ``terms`` is the sum of the sizes of what the products were computed from. A flat series leaves
    only rounding noise of them; a real trend shows at any number of rows, however small its slope.
    """
    slope = F.when(F.abs(products) <= NOISE * terms, F.lit(0.0)).otherwise(slope)
    return F.when(slope > 0, INCREASE).when(slope < 0, DECREASE).otherwise(UNDECIDED)
