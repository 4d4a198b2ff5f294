"""Filling gaps from neighbouring periods, the entity, or the group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.exact import exact_mean, exact_midpoint, exact_totals, rounded_mean
from panelweave.functions.scalars import store_as
from panelweave.operators.spread import (
    TIE,
    group_window,
    in_parts,
    null_safe_join,
    ordering,
    total_order,
    with_group_totals,
    with_group_values,
    with_halo,
    with_last_known,
    without_halo,
)
from panelweave.operators.summary import exact_medians
from panelweave.sources.workspace import pin

EDGES = ("first_value", "lead_then_last", "adjacent")
ACROSS = ("nearest", "linear")


@dataclass(frozen=True)
class NeighbourRule:
    """How a measure's gaps take their neighbours' values.

    A gap between two known rows takes their midpoint; one between two gaps takes the group's mean
    for that period. ``edge`` says what a gap with one known neighbour takes:

    ``first_value``     after a gap, the entity's first row; before a gap, its last row
    ``lead_then_last``  after a gap, the next row; before a gap, the entity's last row
    ``adjacent``        the known neighbour

    The first and last rows may themselves be gaps, and then nothing is filled. ``digits`` rounds
    midpoints and means; the result always takes the column's own type.
    """

    edge: str = "adjacent"
    digits: int | None = None

    def __post_init__(self):
        if self.edge not in EDGES:
            raise ValueError(f"edge must be one of {EDGES}")


def fill_previous_category(
    df: DataFrame,
    entity: str,
    period: str,
    column: str,
    key: str | None = None,
    mode: str = "lag1",
    split: bool = True,
) -> DataFrame:
    """Fill a category from the row before (``lag1``) or the last known one (``last_seen``)."""
    if mode not in ("lag1", "last_seen"):
        raise ValueError("mode must be lag1 or last_seen")
    df, order = total_order(df, period, key)

    def filled(rows: DataFrame) -> DataFrame:
        if mode == "lag1":
            rows = with_halo(rows, [entity], order, before=1)
            previous = F.lag(column).over(group_window(rows, [entity]).orderBy(*ordering(order)))
            rows = without_halo(rows.withColumn("_previous", previous))
        else:
            rows = with_last_known(rows, [entity], order, column, "_previous")
        return rows.withColumn(column, F.coalesce(column, "_previous")).drop("_previous")

    return in_parts(df, [entity], order, filled, split).drop(TIE)


def group_means(df: DataFrame, group: str, period: str, measures: Sequence[str]) -> DataFrame:
    """Written table of the total of each measure per group and period, as ``_mean_<measure>``.

    The totals are exact (:func:`exact_totals`), so the means taken from them are the same in every run.
    A window over these few large groups would put each in one task; this combines map-side. Being
    written, the table has a known size, and the planner broadcasts it only if it is small.
    """
    return pin(exact_totals(df, [group, period], {f"_mean_{m}": m for m in measures}), "means")


def fill_neighbours(
    df: DataFrame,
    entity: str,
    period: str,
    group: str,
    rules: Mapping[str, NeighbourRule],
    key: str | None = None,
    means: DataFrame | None = None,
    split: bool = True,
) -> DataFrame:
    """Fill each measure's gaps from the adjacent rows by its :class:`NeighbourRule`.

    All measures share one window over the entity. ``means`` may pass a table made by
    :func:`group_means` that several fills use. ``key`` orders rows of one period; without it a
    hash of the row does.
    """
    df, order = total_order(df, period, key)
    if means is None:
        means = group_means(df, group, period, list(rules))
    position = F.struct(*order)
    ends = {}
    for m, rule in rules.items():
        if rule.edge == "first_value":
            ends[f"_first_{m}"] = F.min_by(m, position)
        if rule.edge != "adjacent":
            ends[f"_last_{m}"] = F.max_by(m, position)

    def filled(rows: DataFrame) -> DataFrame:
        rows = with_halo(rows, [entity], order, before=1, after=1)
        window = group_window(rows, [entity]).orderBy(*ordering(order))
        steps = {}
        for m in rules:
            steps[f"_lag_{m}"] = F.lag(m).over(window)
            steps[f"_lead_{m}"] = F.lead(m).over(window)
        rows = without_halo(rows.withColumns(steps))
        if ends:
            rows = with_group_values(rows, [entity], ends)
        rows = _with_means(rows, means, group, period, list(rules))
        values = {m: _filled(m, rule, df.schema[m].dataType) for m, rule in rules.items()}
        return rows.withColumns(values).drop(*steps, *ends, *[f"_mean_{m}" for m in rules])

    return in_parts(df, [entity], order, filled, split).drop(TIE)


def _filled(m: str, rule: NeighbourRule, dtype: T.DataType) -> Column:
    lag, lead, total = F.col(f"_lag_{m}"), F.col(f"_lead_{m}"), f"_mean_{m}"
    if rule.digits is None:
        middle, mean = (lag + lead) / 2, exact_mean(total, dtype)
    else:
        middle = exact_midpoint(lag, lead, dtype, rule.digits)
        mean = rounded_mean(total, rule.digits)
    after_gap = F.col(f"_first_{m}") if rule.edge == "first_value" else lead
    before_gap = lag if rule.edge == "adjacent" else F.col(f"_last_{m}")
    one_sided = F.when(lag.isNull(), after_gap).otherwise(before_gap)
    alone = F.coalesce(lag, lead).isNull()
    # The midpoint is NULL unless both neighbours are known.
    return store_as(F.coalesce(F.col(m), middle, F.when(alone, mean).otherwise(one_sided)), dtype)


def fill_across(
    df: DataFrame,
    entity: str,
    period: str,
    group: str,
    measures: Sequence[str],
    method: str = "linear",
    key: str | None = None,
    means: DataFrame | None = None,
    split: bool = True,
) -> DataFrame:
    """Fill runs of gaps of any length from the known rows on either side of the run.

    ``linear`` draws a line between them over the period, a number or a date; rows of one period take
    their midpoint. ``nearest`` takes the one whose period is closer, the earlier one if both are equally
    close. A run at an end of the entity takes its one known neighbour, and an entity without any known
    value the group's mean for the period. The result takes the column's own type.
    """
    if method not in ACROSS:
        raise ValueError(f"method must be one of {ACROSS}")
    if means is None:
        means = group_means(df, group, period, measures)
    df, order = total_order(df, period, key)
    place = F.col(period)
    if isinstance(df.schema[period].dataType, T.DateType):
        place = F.unix_date(place)
    place = place.cast("double")

    def filled(rows: DataFrame) -> DataFrame:
        for m in measures:
            known = F.struct(F.col(m).alias("value"), place.alias("place"))
            rows = rows.withColumn(f"_known_{m}", F.when(F.col(m).isNotNull(), known))
        # All of one direction first: they share a sort.
        for side, reverse in (("before", False), ("after", True)):
            for m in measures:
                rows = with_last_known(
                    rows, [entity], order, f"_known_{m}", f"_{side}_{m}", reverse
                )
        rows = _with_means(rows, means, group, period, measures)
        values = {m: _across(m, place, method, df.schema[m].dataType) for m in measures}
        helpers = [f"_{part}_{m}" for m in measures for part in ("known", "before", "after", "mean")]
        return rows.withColumns(values).drop(*helpers)

    return in_parts(df, [entity], order, filled, split).drop(TIE)


def _across(m: str, place: Column, method: str, dtype: T.DataType) -> Column:
    before, after = F.col(f"_before_{m}"), F.col(f"_after_{m}")
    since, until = place - before["place"], after["place"] - place
    if method == "nearest":
        between = F.when(until < since, after["value"]).otherwise(before["value"])
    else:
        part = F.coalesce(F.try_divide(since, since + until), F.lit(0.5))
        low, high = before["value"].cast("double"), after["value"].cast("double")
        between = low + (high - low) * part
    between = F.when(before.isNotNull() & after.isNotNull(), between)
    one_sided = F.coalesce(before["value"], after["value"], exact_mean(f"_mean_{m}", dtype))
    return F.coalesce(F.col(m), store_as(F.coalesce(between, one_sided), dtype))


def fill_mean_cascade(
    df: DataFrame,
    entity: str,
    period: str,
    group: str,
    measures: Sequence[str],
    means: DataFrame | None = None,
    split: bool = True,
    stat: str = "mean",
) -> DataFrame:
    """Fill gaps with the entity's mean, or the group's mean for the period if it has no value.

    ``stat="median"`` takes the median of both instead; ``means`` is then not used.
    """
    if stat not in ("mean", "median"):
        raise ValueError("stat must be mean or median")
    if stat == "median":
        means = _medians(df, [group, period], measures, "_mean_")
        out = null_safe_join(df, _medians(df, [entity], measures, "_own_"), [entity])
    else:
        if means is None:
            means = group_means(df, group, period, measures)
        out = with_group_totals(df, [entity], {f"_own_{m}": m for m in measures}, split)
    out = _with_means(out, means, group, period, measures)
    filled = {}
    for m in measures:
        own, mean, dtype = f"_own_{m}", f"_mean_{m}", df.schema[m].dataType
        if stat == "mean":
            own, mean = exact_mean(own, dtype), exact_mean(mean, dtype)
        filled[m] = F.coalesce(F.col(m), store_as(F.coalesce(own, mean), dtype))
    out = out.withColumns(filled)
    return out.drop(*[f"_own_{m}" for m in measures], *[f"_mean_{m}" for m in measures])


def _medians(df: DataFrame, by: Sequence[str], measures: Sequence[str], prefix: str) -> DataFrame:
    """Written table of the exact median of each measure per ``by``; one row for every group."""
    table = df.select(*by).distinct()
    for m in measures:
        median = exact_medians(df, by, m).withColumnRenamed("_median", f"{prefix}{m}")
        table = null_safe_join(table, median, by)
    return pin(table, "medians")


def _with_means(
    df: DataFrame, means: DataFrame, group: str, period: str, measures: Sequence[str]
) -> DataFrame:
    wanted = means.select(group, period, *[f"_mean_{m}" for m in measures])
    return null_safe_join(df, wanted, [group, period])

