"""Counting what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import missing_count


def missing_audit(
    df: DataFrame, columns: Sequence[str] | None = None, zero_is_missing: bool = False
) -> DataFrame:
    """One row: per column, how many values are NULL or the empty string."""
    return df.agg(
        *[
            missing_count(c, df.schema[c].dataType, zero_is_missing).alias(c)
            for c in columns or df.columns
        ]
    )


def missing_by_group(df: DataFrame, entity: str, measure: str) -> DataFrame:
    """Missing values of ``measure`` per entity, the worst entity first."""
    missing = F.count(F.lit(1)) - F.count(measure)
    counts = df.groupBy(entity).agg(missing.alias("null_value"))
    return counts.orderBy(F.desc("null_value"), F.asc(entity))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The categories of ``column`` with their number of rows."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
