"""Rows and entities at the minimum or maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.exact import exact_mean, exact_totals
from panelweave.sources.workspace import pin

# Result labels.
LOWEST, HIGHEST = "lowest_expectancy", "highest_expectancy"


def rows_at_extremes(df: DataFrame, measure: str, columns: Sequence[str]) -> DataFrame:
    """All rows whose ``measure`` equals its overall minimum or maximum."""
    lowest = df.agg(F.min(measure)).scalar()
    highest = df.agg(F.max(measure)).scalar()
    at_extreme = (F.col(measure) == lowest) | (F.col(measure) == highest)
    return df.filter(at_extreme).select(*columns)


def extreme_group_profile(
    df: DataFrame,
    entity: str,
    rank_by: str,
    measures: Sequence[str],
    labels: tuple[str, str] = (LOWEST, HIGHEST),
) -> DataFrame:
    """Means of ``measures`` for the entities with the lowest and the highest mean of ``rank_by``.

    Ties are kept, as the means are exact; an entity that is both counts as lowest. The means are written
    once, as they are read both for the extremes and for the result.
    """
    totals = {"_rank": rank_by, **{f"avg_{m}": m for m in measures}}
    known = df.filter(F.col(entity).isNotNull())
    means = exact_totals(known, [entity], totals)
    means = means.withColumns(
        {out: exact_mean(out, df.schema[m].dataType) for out, m in totals.items()}
    )
    means = pin(means, "entity-means")
    lowest = means.agg(F.min("_rank")).scalar()
    highest = means.agg(F.max("_rank")).scalar()
    ranked = means.withColumn("_low", lowest).withColumn("_high", highest)
    low, high = F.col("_rank") == F.col("_low"), F.col("_rank") == F.col("_high")
    ranking = F.when(low, labels[0]).otherwise(labels[1])
    return ranked.filter(low | high).select(
        entity, ranking.alias("ranking"), *[f"avg_{m}" for m in measures]
    )
