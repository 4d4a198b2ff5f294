"""Correlation as one-pass aggregates.

Spark's variance and covariance aggregates merge centred moments, so one scan is enough and large
means do not cancel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centred_correlation(x: Column, y: Column) -> Column:
    """Correlation where each variable is centred on the mean of its own known values.

    The products run over the rows where both are known, each sum of squares over all rows where
    that variable is known. Without NULLs this is the usual coefficient. NULL if either is constant.
    """
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, 1))
    shift = (F.avg(F.when(both, x)) - F.avg(x)) * (F.avg(F.when(both, y)) - F.avg(y))
    products = n * (F.covar_pop(x, y) + shift)
    return F.try_divide(products, _spread(x) * _spread(y))


def pairwise_correlation(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are known. NULL if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def _spread(x: Column) -> Column:
    return F.sqrt(F.var_pop(x) * F.count(x))
