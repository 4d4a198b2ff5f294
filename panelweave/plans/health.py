"""The yearly country health panel: its cleaning rules and the questions asked of it.

``clean_health_panel`` takes the raw table; each question takes the cleaned panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelweave.operators import (
    NeighbourRule,
    cast_failures,
    describe_by_group,
    extreme_group_profile,
    latest_group_mean,
    mean_by_subgroup,
    mean_by_tier,
    mean_by_two_tiers,
    missing_audit,
    missing_by_group,
    pareto_tiers,
    pearson,
    pearson_by_group,
    rename_columns,
    rolling_mean,
    rows_at_extremes,
    trend_slope,
)
from panelweave.plans.clean import CleaningSpec, Ratio, clean_panel, prepare_panel

ENTITY, PERIOD, GROUP, KEY = "Country", "Year", "Status", "Row_ID"

# The raw table's columns in the order of its audit.
RAW_COLUMNS = (
    "Country",
    "Year",
    "Status",
    "Lifeexpectancy",
    "AdultMortality",
    "infantdeaths",
    "percentageexpenditure",
    "Measles",
    "BMI",
    "under-fivedeaths",
    "Polio",
    "Diphtheria",
    "HIVAIDS",
    "GDP",
    "thinness1-19years",
    "thinness5-9years",
    "Schooling",
    "Row_ID",
)

# The column names that change, and the rules per column.
RENAMES = {
    "under-fivedeaths": "under_fivedeaths",
    "thinness1-19years": "thinness10_19years",
    "thinness5-9years": "thinness5_9years",
}
MEASURES = (
    "AdultMortality",
    "infantdeaths",
    "percentageexpenditure",
    "Measles",
    "BMI",
    "under_fivedeaths",
    "Polio",
    "Diphtheria",
    "HIVAIDS",
    "GDP",
    "thinness10_19years",
    "thinness5_9years",
    "Schooling",
)
UNBLANKED = ("HIVAIDS",)

HEALTH_SPEC = CleaningSpec(
    key=KEY,
    entity=ENTITY,
    period=PERIOD,
    group=GROUP,
    renames=RENAMES,
    blanks=("Status", "Lifeexpectancy", *[m for m in MEASURES if m not in UNBLANKED]),
    types={
        "Year": "int",
        "Row_ID": "bigint",
        "Lifeexpectancy": "decimal(4,2)",
        **dict.fromkeys(MEASURES, "double"),
    },
    previous_category="Status",
    neighbour_fills={
        "Lifeexpectancy": NeighbourRule("first_value"),
        "AdultMortality": NeighbourRule("first_value"),
        "Schooling": NeighbourRule("lead_then_last", 2),
        "GDP": NeighbourRule("adjacent", 2),
    },
    mean_fills=(
        "infantdeaths",
        "under_fivedeaths",
        "thinness10_19years",
        "thinness5_9years",
        "Polio",
        "Diphtheria",
        "BMI",
        "Measles",
        "percentageexpenditure",
    ),
    late_renames={"percentageexpenditure": "health_expenditure"},
    low_outliers={
        "AdultMortality": 2,
        "Polio": 0,
        "Diphtheria": 0,
        "GDP": 2,
        "thinness10_19years": 2,
        "thinness5_9years": 2,
        "health_expenditure": 2,
    },
    ranges={"BMI": (15, 40)},
    ratio=Ratio("health_expenditure", "GDP", "percentageexpenditure"),
)

# Running shares in percent at which a tier ends, and the places shares are rounded to.
GDP_CUTS, MEASLES_CUTS, POLIO_CUTS = (71, 90), (81,), (61,)
SHARE_DIGITS = 4


def audit_health_panel(raw: DataFrame) -> DataFrame:
    return missing_audit(rename_columns(raw, RENAMES))


def cast_losses(raw: DataFrame) -> DataFrame:
    """Per column, how many non-blank values of the raw table the cleaning turns into gaps."""
    return cast_failures(rename_columns(raw, RENAMES), HEALTH_SPEC.types)


def missing_gdp(raw: DataFrame) -> DataFrame:
    return missing_by_group(prepare_panel(raw, HEALTH_SPEC), ENTITY, "GDP")


def clean_health_panel(raw: DataFrame) -> DataFrame:
    return clean_panel(raw, HEALTH_SPEC)


def life_expectancy_summary(panel: DataFrame) -> DataFrame:
    return describe_by_group(panel, ENTITY, "Lifeexpectancy", nulls="first")


def life_expectancy_trend(panel: DataFrame) -> DataFrame:
    return trend_slope(panel, ENTITY, PERIOD, "Lifeexpectancy", carry=GROUP).orderBy(ENTITY)


def latest_status_comparison(panel: DataFrame) -> DataFrame:
    return latest_group_mean(panel, GROUP, PERIOD, "Lifeexpectancy")


def mortality_correlation(panel: DataFrame) -> DataFrame:
    return pearson(panel, [("AdultMortality", "Lifeexpectancy")])


def gdp_tiers(panel: DataFrame) -> DataFrame:
    tiers = pareto_tiers(
        panel,
        ENTITY,
        "GDP",
        GDP_CUTS,
        period=PERIOD,
        out="GDP_tier",
        position=False,
        digits=SHARE_DIGITS,
    )
    return tiers.select(ENTITY, "GDP_tier")


def life_expectancy_by_gdp(panel: DataFrame) -> DataFrame:
    return mean_by_tier(panel, gdp_tiers(panel), ENTITY, "Lifeexpectancy", "GDP_tier")


def measles_tiers(panel: DataFrame) -> DataFrame:
    return pareto_tiers(
        panel, ENTITY, "Measles", MEASLES_CUTS, stat="mean", out="Measles_tier", digits=SHARE_DIGITS
    )


def polio_tiers(panel: DataFrame) -> DataFrame:
    return pareto_tiers(
        panel, ENTITY, "Polio", POLIO_CUTS, stat="mean", out="Polio_tier", digits=SHARE_DIGITS
    )


def life_expectancy_by_disease(panel: DataFrame) -> DataFrame:
    return mean_by_two_tiers(
        panel,
        polio_tiers(panel),
        measles_tiers(panel),
        ENTITY,
        "Lifeexpectancy",
        "Polio_tier",
        "Measles_tier",
    )


def schooling_correlation(panel: DataFrame) -> DataFrame:
    return pearson(panel, [("Schooling", "Lifeexpectancy")])


def schooling_extremes(panel: DataFrame) -> DataFrame:
    return rows_at_extremes(panel, "Schooling", [ENTITY, "Schooling", "Lifeexpectancy"])


def bmi_trend(panel: DataFrame) -> DataFrame:
    return trend_slope(panel, ENTITY, PERIOD, "BMI").orderBy(ENTITY)


def child_deaths_at_extremes(panel: DataFrame) -> DataFrame:
    return extreme_group_profile(
        panel, ENTITY, "Lifeexpectancy", ["infantdeaths", "under_fivedeaths"]
    )


def mortality_moving_average(panel: DataFrame) -> DataFrame:
    averaged = rolling_mean(panel, ENTITY, PERIOD, "AdultMortality", key=KEY)
    return averaged.select(ENTITY, PERIOD, "moving_avg")


def expenditure_correlation(panel: DataFrame) -> DataFrame:
    return pearson(panel, [("percentageexpenditure", "Lifeexpectancy")])


def bmi_correlations(panel: DataFrame) -> DataFrame:
    return pearson(panel, [("BMI", "Lifeexpectancy"), ("BMI", "AdultMortality")])


GDP_PAIRS = [("GDP", "Lifeexpectancy"), ("GDP", "AdultMortality"), ("GDP", "infantdeaths")]


def gdp_correlations(panel: DataFrame) -> DataFrame:
    return pearson(panel, GDP_PAIRS)


def gdp_correlations_by_tier(panel: DataFrame) -> DataFrame:
    tiers = gdp_tiers(panel).filter("GDP_tier IN ('high', 'low')")
    return pearson_by_group(panel.join(tiers, ENTITY), "GDP_tier", GDP_PAIRS)


def life_expectancy_by_region(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions`` gives each country its region, a column the panel itself does not have."""
    return mean_by_subgroup(panel, regions, ENTITY, ["region"], "Lifeexpectancy")


# Every question that needs the cleaned panel only, in the order they are asked.
QUESTIONS = {
    "life_expectancy_summary": life_expectancy_summary,
    "life_expectancy_trend": life_expectancy_trend,
    "latest_status_comparison": latest_status_comparison,
    "mortality_correlation": mortality_correlation,
    "life_expectancy_by_gdp": life_expectancy_by_gdp,
    "life_expectancy_by_disease": life_expectancy_by_disease,
    "schooling_correlation": schooling_correlation,
    "schooling_extremes": schooling_extremes,
    "bmi_trend": bmi_trend,
    "child_deaths_at_extremes": child_deaths_at_extremes,
    "mortality_moving_average": mortality_moving_average,
    "expenditure_correlation": expenditure_correlation,
    "bmi_correlations": bmi_correlations,
    "gdp_correlations": gdp_correlations,
    "gdp_correlations_by_tier": gdp_correlations_by_tier,
}
