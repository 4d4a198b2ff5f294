"""Trend of a measure over the periods of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import trend_label
from panelweave.operators.spread import in_parts, running_totals, span_fits, with_group_values


def trend_slope(
    df: DataFrame,
    entity: str,
    period: str,
    measure: str,
    carry: str | None = None,
    pairwise: bool = False,
) -> DataFrame:
    """Least-squares slope of measure / entity mean against the rank of the period, and its label.

    Rows without a value still have a rank and count in the spread of the ranks; ``pairwise=True``
    leaves them out. ``carry`` adds a column, with one output row per entity and carried value.

    The work runs on one row per entity and period: all rows of a period share a rank.
    """
    value = F.col(measure).cast("double")
    cells = (
        df.filter(F.col(entity).isNotNull())
        .groupBy(entity, period)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(value).alias("_known"),
            F.sum(value).alias("_sum"),
        )
    )
    weight = F.col("_known") if pairwise else F.col("_rows")

    def placed(cells: DataFrame) -> DataFrame:
        cells = running_totals(cells, [entity], [period], {"_upto": F.col("_rows")}, split=False)
        rank = (F.col("_upto") - F.col("_rows") + 1).cast("double")
        cells = cells.withColumn("_x", rank).withColumn("_w", weight.cast("double"))
        return with_group_values(
            cells,
            [entity],
            {
                "_wx": F.sum(F.col("_w") * F.col("_x")),
                "_weights": F.sum("_w"),
                "_total": F.sum("_sum"),
                "_count": F.sum("_known"),
            },
        )

    cells = in_parts(cells, [entity], [period], placed, split=not span_fits(df, period))
    x = F.col("_x") - F.try_divide(F.col("_wx"), F.col("_weights"))
    # Values relative to the entity's mean average to 1.
    mean = F.try_divide(F.col("_total"), F.col("_count"))
    share = F.try_divide(F.col("_sum"), mean)
    cells = cells.withColumns(
        {
            "_xy": x * (share - F.col("_known")),
            "_xx": F.col("_w") * x * x,
            "_size": F.abs(x) * (F.abs(share) + F.col("_known")),
        }
    )
    sums = cells.groupBy(entity).agg(*[F.sum(c).alias(c) for c in ("_xy", "_xx", "_size")])
    slope = F.try_divide("_xy", "_xx")
    trend = trend_label(slope, F.col("_xy"), F.col("_size"))
    slopes = sums.select(entity, slope.alias("slope"), trend.alias("trend"))
    if carry is None:
        return slopes
    carried = df.filter(F.col(entity).isNotNull()).select(entity, carry).distinct()
    return carried.join(slopes, entity).select(entity, carry, "slope", "trend")
