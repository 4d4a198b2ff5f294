from panelweave.operators.audit import distinct_values, missing_audit, missing_by_group
from panelweave.operators.correlate import pearson, pearson_by_group
from panelweave.operators.extremes import extreme_group_profile, rows_at_extremes
from panelweave.operators.fill import (
    NeighbourRule,
    fill_across,
    fill_mean_cascade,
    fill_neighbours,
    fill_previous_category,
    group_means,
)
from panelweave.operators.layout import store_by_entity
from panelweave.operators.prepare import (
    apply_corrections,
    blank_to_null,
    cast_failures,
    cast_measures,
    delete_by_key,
    derive_ratio,
    rename_columns,
)
from panelweave.operators.repair import (
    dedupe_keyed,
    replace_low_outliers,
    replace_out_of_range,
)
from panelweave.operators.rolling import rolling_mean
from panelweave.operators.spread import running_totals
from panelweave.operators.summary import (
    describe_by_group,
    latest_group_mean,
    mean_by_subgroup,
)
from panelweave.operators.tiers import mean_by_tier, mean_by_two_tiers, pareto_tiers
from panelweave.operators.trend import trend_slope

__all__ = [
    "NeighbourRule",
    "apply_corrections",
    "blank_to_null",
    "cast_failures",
    "cast_measures",
    "dedupe_keyed",
    "delete_by_key",
    "derive_ratio",
    "describe_by_group",
    "distinct_values",
    "extreme_group_profile",
    "fill_across",
    "fill_mean_cascade",
    "fill_neighbours",
    "fill_previous_category",
    "group_means",
    "latest_group_mean",
    "mean_by_subgroup",
    "mean_by_tier",
    "mean_by_two_tiers",
    "missing_audit",
    "missing_by_group",
    "pareto_tiers",
    "pearson",
    "pearson_by_group",
    "rename_columns",
    "replace_low_outliers",
    "replace_out_of_range",
    "rolling_mean",
    "rows_at_extremes",
    "running_totals",
    "store_by_entity",
    "trend_slope",
]
