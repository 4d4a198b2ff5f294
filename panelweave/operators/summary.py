"""Summaries per entity, group and subgroup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.exact import (
    exact_mean,
    exact_midpoint,
    exact_totals,
    merged_totals,
    rounded_mean,
)
from panelweave.functions.scalars import round_half_up
from panelweave.operators.spread import null_safe_join, running_totals
from panelweave.sources.workspace import pin

NULL_RANKS = ("skip", "first")


# Rank error of a sketch, as a part of the group's values, and how many values it surely keeps one by one.
SKETCH_ACCURACY = 10_000
KEPT_VALUES = SKETCH_ACCURACY // 5
# Shares of a group at which its sketch is read: steps, finer ones around the middle, and the two middle values.
STEPS = [i / 64 for i in range(65)] + [0.5 + k / SKETCH_ACCURACY for k in (-20, -6, -3, 3, 6, 20)]
MIDDLE = [0.5, 0.5 + 1e-9]


def describe_by_group(
    df: DataFrame, entity: str, measure: str, nulls: str = "skip", digits: int = 2
) -> DataFrame:
    """Mean, minimum, maximum and exact median of ``measure`` per entity.

    ``nulls='first'`` ranks NULLs before all values but takes the middle ranks of the known values
    only, so an entity with gaps gets a lower median; ``skip`` is the usual median. Medians are found as in
    :func:`exact_medians`, whose first scan yields the other figures as well.
    """
    rows = df.filter(F.col(entity).isNotNull()).select(entity, F.col(measure).alias("_v"))
    basic = {"minimum": F.min("_v"), "maximum": F.max("_v")}
    described = exact_medians(rows, [entity], "_v", nulls, basic, {"_total": "_v"})
    average = rounded_mean("_total", digits).alias("average")
    median = round_half_up(F.col("_median"), digits).alias("median")
    return described.select(entity, average, *basic, median)


def exact_medians(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    nulls: str = "skip",
    also: Mapping[str, Column] | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Median of ``measure`` per ``by`` as ``_median``, one row for each group; ``nulls`` as in :func:`describe_by_group`.

    A first scan takes a quantile sketch of each group, which merges before the shuffle, with the aggregates
    ``also`` and the exact ``totals``. Of a group so small that the sketch keeps all its values, it gives the median. For others it gives a bracket
    around the middle ranks: a second scan counts what is below and keeps the few values inside, whose running
    counts give the values of those ranks. Should a rank lie outside its bracket, the group is counted in full.
    """
    if nulls not in NULL_RANKS:
        raise ValueError(f"nulls must be one of {NULL_RANKS}")
    dtype = df.schema[measure].dataType
    value = F.col(measure)
    sketch = {
        "_sketch": F.percentile_approx(value, [*STEPS, *MIDDLE], SKETCH_ACCURACY),
        "_known": F.count(value),
        "_rows": F.count(F.lit(1)),
    }
    also, totals = also or {}, totals or {}
    groups = exact_totals(df, by, totals, {**sketch, **also})
    also = [*also, *totals]
    # Of the known values, those of the ranks low and high are wanted; NULLs may take the first ranks.
    skipped = F.col("_rows") - F.col("_known") if nulls == "first" else F.lit(0)
    groups = groups.withColumns(
        {
            "_low": F.floor((F.col("_known") + 1) / 2) - skipped,
            "_high": F.ceil((F.col("_known") + 1) / 2) - skipped,
        }
    )
    kept = (F.col("_known") <= KEPT_VALUES) & (skipped == 0) if _sketch_is_exact(dtype) else F.lit(False)
    first, second = (F.get("_sketch", F.lit(len(STEPS) + i)) for i in (0, 1))
    middle = F.when(F.col("_high") >= 1, exact_midpoint(first, second, dtype).cast("double"))
    groups = groups.withColumn("_settled", kept | (F.col("_high") < 1)).withColumn("_median", middle)
    groups = groups.withColumn("_sketch", F.when(~F.col("_settled"), F.col("_sketch")))
    groups = pin(groups, "sketches")
    settled = groups.filter("_settled").select(*by, *also, "_median")
    open_ = groups.filter("NOT _settled")
    wanted = open_.count()
    if not wanted:
        return settled
    brackets = open_.select(*by, "_low", "_high", *_bracket())
    found = pin(_values_of_ranks(df, by, measure, brackets), "medians")
    if found.count() < wanted:
        missed = null_safe_join(brackets, found.select(*by), by, "left_anti")
        missed = missed.withColumns({"_from": F.lit(None).cast(dtype), "_to": F.lit(None).cast(dtype)})
        missed = pin(missed, "missed")
        found = found.unionByName(pin(_values_of_ranks(df, by, measure, missed), "medians"))
    # With NULLs first, the lower rank may be that of a NULL.
    middle = exact_midpoint(F.coalesce("_first", "_second"), F.col("_second"), dtype).cast("double")
    found = found.select(*by, middle.alias("_median"))
    counted = null_safe_join(open_.select(*by, *also), found, by)
    return settled.unionByName(counted)


def _sketch_is_exact(dtype: T.DataType) -> bool:
    """Whether values survive the sketch, which holds doubles."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 15
    return isinstance(dtype, T.NumericType) and not isinstance(dtype, T.LongType)


def _bracket() -> list[Column]:
    """Values of the sketch that surely enclose the ranks, as far as its promise goes; NULL where none does."""
    error = F.ceil(F.col("_known") / SKETCH_ACCURACY) + 1

    def place(share: float) -> Column:
        return F.ceil(F.col("_known") * share)

    values = [F.get("_sketch", F.lit(i)) for i in range(len(STEPS))]
    below = [F.when(place(p) + error < F.col("_low"), v) for p, v in zip(STEPS, values, strict=True)]
    above = [F.when(place(p) - error > F.col("_high"), v) for p, v in zip(STEPS, values, strict=True)]
    return [F.greatest(*below).alias("_from"), F.least(*above).alias("_to")]


def _values_of_ranks(
    df: DataFrame, by: Sequence[str], measure: str, brackets: DataFrame
) -> DataFrame:
    """The values of the ranks ``_low`` and ``_high``, as ``_first`` and ``_second``, where they lie in the bracket.

    ``brackets`` is a written table of the groups asked for. Rows above the bracket go, those below are one
    level per group, so the running counts are over the values inside only.
    """
    rows = null_safe_join(df.select(*by, F.col(measure).alias("_v")), brackets, by, "inner")
    rows = rows.filter("_v IS NOT NULL AND (_to IS NULL OR _v <= _to)")
    below = F.coalesce(F.col("_v") < F.col("_from"), F.lit(False))
    level = F.when(~below, F.col("_v")).alias("_level")
    levels = rows.groupBy(*by, level).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value("_low").alias("_low"), F.any_value("_high").alias("_high")
    )
    levels = running_totals(pin(levels, "levels"), by, ["_level"], {"_upto": F.col("_n")})

    def at(rank: str) -> Column:
        covered = (F.col("_upto") - F.col("_n") < F.col(rank)) & (F.col(rank) <= F.col("_upto"))
        return F.max(F.when(covered, F.col("_level")))

    found = levels.groupBy(*by).agg(
        at("_low").alias("_first"), at("_high").alias("_second"), F.any_value("_low").alias("_low")
    )
    # A rank below 1 is that of a NULL; any other must be found.
    found = found.filter("_second IS NOT NULL AND (_first IS NOT NULL OR _low < 1)")
    return found.select(*by, "_first", "_second")


def latest_group_mean(
    df: DataFrame, group: str, period: str, measure: str, digits: int = 0
) -> DataFrame:
    """Each group's rounded mean of ``measure`` in the group's own latest period."""
    totals = exact_totals(df, [group, period], {"_total": measure})
    means = totals.select(group, period, rounded_mean("_total", digits).alias("_mean"))
    return means.groupBy(group).agg(F.max_by("_mean", period).alias("latest_average"))


def mean_by_subgroup(
    df: DataFrame, dim: DataFrame, on: str, subgroups: Sequence[str], measure: str
) -> DataFrame:
    """Mean of ``measure`` by attributes that ``dim`` gives for the key ``on``.

    Rows are summed per key before the join, so a frequent key is one row by then.
    """
    joined = partial_totals(df, on, measure).join(dim.select(on, *subgroups), on)
    return mean_of_totals(joined, subgroups, f"avg_{measure}")


def partial_totals(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Exact total of ``measure`` per ``by``; :func:`mean_of_totals` turns them into a mean."""
    return exact_totals(df, [by], {"_total": measure})


def mean_of_totals(totals: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Mean per ``by`` from the totals of its parts."""
    merged = totals.groupBy(*by).agg(merged_totals(F.col("_total")).alias(out))
    return merged.withColumn(out, exact_mean(out))
