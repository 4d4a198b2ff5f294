"""Cleaning a raw panel from start to end."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.scalars import blank_as_null, zero_as_null
from panelweave.operators.fill import (
    NeighbourRule,
    fill_mean_cascade,
    fill_neighbours,
    fill_previous_category,
    group_means,
)
from panelweave.operators.prepare import derive_ratio, rename_columns
from panelweave.operators.repair import (
    dedupe_keyed,
    replace_low_outliers,
    replace_out_of_range,
)
from panelweave.operators.spread import is_split, separate_heavy, unsplit
from panelweave.sources.workspace import pin


@dataclass(frozen=True)
class Ratio:
    num: str
    den: str
    out: str
    digits: int = 2
    factor: float = 100.0


@dataclass(frozen=True)
class CleaningSpec:
    """Which rule applies to which column. Rules a panel does not need stay empty."""

    key: str
    entity: str
    period: str
    group: str
    renames: Mapping[str, str] = field(default_factory=dict)
    blanks: tuple[str, ...] = ()
    types: Mapping[str, T.DataType | str] = field(default_factory=dict)
    zeros_missing: tuple[str, ...] = ()
    previous_category: str | None = None
    neighbour_fills: Mapping[str, NeighbourRule] = field(default_factory=dict)
    mean_fills: tuple[str, ...] = ()
    late_renames: Mapping[str, str] = field(default_factory=dict)
    low_outliers: Mapping[str, int] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    ratio: Ratio | None = None


def prepare_panel(raw: DataFrame, spec: CleaningSpec) -> DataFrame:
    """Rename, turn blanks into NULL and cast, in one projection."""
    df = rename_columns(raw, spec.renames)
    columns = []
    for c in df.columns:
        value = blank_as_null(c) if c in spec.blanks else F.col(f"`{c}`")
        if c in spec.types:
            value = value.try_cast(spec.types[c])
        if c in spec.zeros_missing:
            value = zero_as_null(value)
        columns.append(value.alias(c))
    return df.select(*columns)


def clean_panel(raw: DataFrame, spec: CleaningSpec) -> DataFrame:
    """Clean ``raw`` in the order: prepare, fill, dedupe, replace outliers, derive the ratio.

    Fills run before the dedupe, so repeated rows are neighbours too. All steps keep the rows
    partitioned by entity, so they share one shuffle; the group means are computed once for all
    fills, on a second pass. Entities too large for one task are cleaned apart from the others: their
    rows alone are written between the steps, because a step over split entities reads its input
    more than once. Both parts use the same group means.
    """
    order = [spec.period, spec.key]
    parts = separate_heavy(prepare_panel(raw, spec), [spec.entity], order)
    parts = [part for part in parts if part is not None]
    if spec.previous_category:
        parts = [_fill_category(part, spec) for part in parts]
    means = None
    filled = [*spec.neighbour_fills, *spec.mean_fills]
    if filled:
        columns = list(dict.fromkeys([spec.group, spec.period, *filled]))
        known = [part.select(*columns) for part in parts]
        means = group_means(
            known[0] if len(known) == 1 else known[0].unionByName(known[1]),
            spec.group,
            spec.period,
            filled,
        )
    parts = [unsplit(_clean_part(part, spec, means)) for part in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _fill_category(df: DataFrame, spec: CleaningSpec) -> DataFrame:
    return _settle(
        fill_previous_category(
            df, spec.entity, spec.period, spec.previous_category, spec.key, split=False
        )
    )


def _clean_part(df: DataFrame, spec: CleaningSpec, means: DataFrame | None) -> DataFrame:
    """The steps after the group means, on ordinary entities or on split ones."""
    if spec.neighbour_fills:
        df = _settle(
            fill_neighbours(
                df,
                spec.entity,
                spec.period,
                spec.group,
                spec.neighbour_fills,
                spec.key,
                means,
                split=False,
            )
        )
    if spec.mean_fills:
        df = fill_mean_cascade(
            df, spec.entity, spec.period, spec.group, spec.mean_fills, means, split=False
        )
    df = _settle(dedupe_keyed(df, [spec.entity, spec.period], spec.key))
    df = rename_columns(df, spec.late_renames)
    if spec.low_outliers:
        df = _settle(replace_low_outliers(df, spec.entity, spec.low_outliers, split=False))
    if spec.ranges:
        df = replace_out_of_range(df, spec.entity, spec.ranges, split=False)
    if spec.ratio:
        r = spec.ratio
        df = derive_ratio(df, r.num, r.den, r.out, r.digits, r.factor)
    return df


def _settle(df: DataFrame) -> DataFrame:
    return pin(df, "step") if is_split(df) else df
