from panelweave.functions.exact import (
    below_mean_part,
    exact_mean,
    exact_midpoint,
    exact_totals,
    merged_totals,
    rounded_mean,
    total_as_double,
)
from panelweave.functions.moments import centred_correlation, pairwise_correlation
from panelweave.functions.scalars import (
    blank_as_null,
    in_range,
    missing_count,
    ratio,
    round_half_up,
    store_as,
    tier_label,
    trend_label,
    zero_as_null,
)

__all__ = [
    "below_mean_part",
    "blank_as_null",
    "centred_correlation",
    "exact_mean",
    "exact_midpoint",
    "exact_totals",
    "in_range",
    "merged_totals",
    "missing_count",
    "pairwise_correlation",
    "ratio",
    "round_half_up",
    "rounded_mean",
    "store_as",
    "tier_label",
    "total_as_double",
    "trend_label",
    "zero_as_null",
]
