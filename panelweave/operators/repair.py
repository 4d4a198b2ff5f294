"""Removing repeated rows and replacing implausible values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.exact import below_mean_part, exact_mean, rounded_mean
from panelweave.functions.scalars import in_range, store_as
from panelweave.operators.spread import with_group_totals


def dedupe_keyed(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep, for each combination of ``keys``, the row with the smallest ``order``.

    Spark keeps only the best row per combination of each task before it shuffles, so a much
    repeated combination does not gather in one task.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") == 1).drop("_r")


def replace_low_outliers(
    df: DataFrame,
    entity: str,
    digits: Mapping[str, int],
    divisor: float = 3,
    split: bool = True,
) -> DataFrame:
    """Replace values below the entity's mean / ``divisor`` by that mean, rounded per measure.

    The mean includes the outliers. All measures are judged on the values before any replacement, strictly
    and against the exact mean: a value that is a third of it stays.
    """
    out = with_group_totals(df, [entity], {f"_own_{m}": m for m in digits}, split)
    repaired = {}
    for m, places in digits.items():
        total = f"_own_{m}"
        replacement = store_as(rounded_mean(total, places), df.schema[m].dataType)
        low = below_mean_part(F.col(m), total, divisor)
        repaired[m] = F.when(low, replacement).otherwise(F.col(m))
    return out.withColumns(repaired).drop(*[f"_own_{m}" for m in digits])


def replace_out_of_range(
    df: DataFrame,
    entity: str,
    ranges: Mapping[str, tuple[float, float]],
    split: bool = True,
) -> DataFrame:
    """Replace values outside [lo, hi] by the mean of the entity's values inside it.

    An entity without a value inside the range keeps its values; NULL stays NULL.
    """
    inside = {
        f"_in_{m}": F.when(in_range(F.col(m), lo, hi), F.col(m)) for m, (lo, hi) in ranges.items()
    }
    totals = {f"_mean{name}": name for name in inside}
    out = with_group_totals(df.withColumns(inside), [entity], totals, split)
    repaired = {}
    for m, (lo, hi) in ranges.items():
        dtype = df.schema[m].dataType
        mean = store_as(exact_mean(f"_mean_in_{m}", dtype), dtype)
        outside = ~in_range(F.col(m), lo, hi) & mean.isNotNull()
        repaired[m] = F.when(outside, mean).otherwise(F.col(m))
    return out.withColumns(repaired).drop(*inside, *totals)
