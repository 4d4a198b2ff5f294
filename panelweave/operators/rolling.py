"""Moving averages within an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.spread import (
    TIE,
    group_window,
    in_parts,
    ordering,
    total_order,
    with_group_values,
    with_halo,
    without_halo,
)


def rolling_mean(
    df: DataFrame,
    entity: str,
    period: str,
    measure: str,
    preceding: int = 5,
    warmup: int = 4,
    key: str | None = None,
    out: str = "moving_avg",
    split: bool = True,
) -> DataFrame:
    """Mean of ``measure`` over the row and its ``preceding`` rows; 0 during the warm-up.

    The frame counts rows and the warm-up counts periods since the entity's first.
    """
    df, order = total_order(df, period, key)

    def averaged(rows: DataFrame) -> DataFrame:
        rows = with_halo(rows, [entity], order, before=preceding)
        frame = group_window(rows, [entity]).orderBy(*ordering(order)).rowsBetween(-preceding, 0)
        mean = F.avg(F.col(measure).cast("double")).over(frame)
        rows = without_halo(rows.withColumn(out, mean))
        rows = with_group_values(rows, [entity], {"_first": F.min(period)})
        warming = F.col(period) < F.col("_first") + F.lit(warmup)
        return rows.withColumn(out, F.when(warming, F.lit(0.0)).otherwise(F.col(out))).drop("_first")

    return in_parts(df, [entity], order, averaged, split).drop(TIE)
