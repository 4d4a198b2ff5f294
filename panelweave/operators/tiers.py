"""Tiers by cumulative share of a total, and averages over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.exact import exact_mean, exact_totals, total_as_double
from panelweave.functions.scalars import ratio, round_half_up, tier_label
from panelweave.operators.spread import null_safe_join, ranged_totals
from panelweave.operators.summary import mean_of_totals, partial_totals
from panelweave.sources.workspace import pin

# Parts of a total, of which 10**8 may be added.
PART_TYPE = "decimal(38,30)"


def pareto_tiers(
    df: DataFrame,
    entity: str,
    measure: str,
    cuts: Sequence[float],
    stat: str = "latest",
    period: str | None = None,
    key: str | None = None,
    out: str = "tier",
    position: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """One row per entity: its share of the total in percent, the running share, and its tier.

    The entity's value is that of its ``latest`` period or its ``mean``. Entities run from the
    largest share down, equal shares advance together, and an entity whose running share reaches a
    cut is in the tier below it. ``position`` adds ``counting``, the entity's place in that order,
    ties by entity. An entity without a value comes last, with the whole total as running share.

    Running shares are sums of the values themselves, exact to 10**-30 of the total, so they end at 100
    however many entities there are. With ``digits``, shares are first rounded to decimals of so many places
    and the running share adds the rounded ones; what rounding loses grows with the number of entities.

    Entities and distinct shares are ordered in ranges (:func:`ranged_totals`): no task holds them all.
    """
    if digits is not None and not 0 <= digits <= 14:
        raise ValueError("shares have 0 to 14 digits")
    if stat == "latest":
        if period is None:
            raise ValueError("the latest value needs the period")
        latest = F.max_by(measure, F.struct(period, key) if key else F.col(period))
        values = df.groupBy(entity).agg(latest.cast("double").alias("_value"))
    elif stat == "mean":
        values = exact_totals(df, [entity], {"_value": measure})
        values = values.select(entity, exact_mean("_value").alias("_value"))
    else:
        raise ValueError("stat must be latest or mean")
    total = exact_totals(values, [], {"_sum": "_value"}).select(total_as_double("_sum")).scalar()
    values = values.withColumn("_total", total)
    share = ratio(F.col("_value"), F.col("_total")) * 100
    if digits is None:
        # A power of two near the total: dividing by it loses nothing.
        unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("_total"))))
        part = ratio(F.col("_value"), unit).try_cast(PART_TYPE)
    else:
        share = round_half_up(share, digits).cast(f"decimal({16 + digits},{digits})")
        part = share.cast(f"decimal(38,{digits})")
    shares = values.select(entity, share.alias("percent_in_total"), part.alias("_part"))
    shares = pin(shares, "shares")
    levels = shares.groupBy("percent_in_total").agg(F.sum("_part").alias("_level"))
    levels = ranged_totals(levels, ["-percent_in_total"], {"_upto": F.col("_level")}, "levels")
    rolling = F.col("_upto")
    if digits is None:
        whole = shares.agg(F.sum("_part").cast("double").alias("t")).scalar()
        rolling = ratio(rolling.cast("double"), whole) * 100
    levels = levels.select("percent_in_total", rolling.alias("rolling_percent"))
    shares = shares.drop("_part")
    if position:
        counting = {"counting": F.lit(1)}
        shares = ranged_totals(shares, ["-percent_in_total", entity], counting, "places")
    tiers = null_safe_join(shares, levels, ["percent_in_total"])
    columns = [entity, "percent_in_total", "rolling_percent"] + ["counting"] * position
    return tiers.select(*columns, tier_label(F.col("rolling_percent"), cuts).alias(out))


def mean_by_tier(
    df: DataFrame, tiers: DataFrame, entity: str, measure: str, tier: str = "tier"
) -> DataFrame:
    """Mean of ``measure`` over all rows of each tier's entities."""
    joined = partial_totals(df, entity, measure).join(tiers.select(entity, tier), entity)
    return mean_of_totals(joined, [tier], f"avg_{measure}")


def mean_by_two_tiers(
    df: DataFrame,
    first: DataFrame,
    second: DataFrame,
    entity: str,
    measure: str,
    first_tier: str,
    second_tier: str,
) -> DataFrame:
    """Mean of ``measure`` per combination of two tiers, the highest mean first."""
    both = first.select(entity, first_tier).join(second.select(entity, second_tier), entity)
    joined = partial_totals(df, entity, measure).join(both, entity)
    means = mean_of_totals(joined, [first_tier, second_tier], f"avg_{measure}")
    return means.orderBy(F.desc(f"avg_{measure}"))
