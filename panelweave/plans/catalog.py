"""Every operator as a named query over the order and event tables.

Each takes the session and the tables' folder. Doubles are rounded, since sums of doubles depend on
the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave import operators as ops
from panelweave.functions import exact_mean, exact_totals, round_half_up, rounded_mean
from panelweave.operators import NeighbourRule
from panelweave.plans import health
from panelweave.plans.clean import CleaningSpec, Ratio, clean_panel
from panelweave.plans.samples import (
    MONEY,
    customer_year,
    health_staging,
    regions,
    table,
    user_day,
)
from panelweave.sources import drop_materialized, materialize, pin, read_raw, read_with_quarantine
from panelweave.sources.workspace import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

ID, ENTITY, PERIOD = "row_id", "entity", "period"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, and turn decimals into doubles, for comparison across engines."""
    columns = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
            value = F.round(value.cast("double"), digits)
        columns.append(value.alias(f.name))
    return df.select(*columns)


def stored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The customer-year panel, written first: most operators read their input more than once."""
    return pin(customer_year(spark, folder), "customer-year")


def stored_users(spark: SparkSession, folder: str) -> DataFrame:
    return pin(user_day(spark, folder), "user-day")


def text_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The customer-year panel with its gaps as empty text."""
    panel = customer_year(spark, folder)
    return panel.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("grp", "m1", "m2")}
    )


def orders_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order; customers' years repeat."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(ID),
        F.col("o_custkey").alias(ENTITY),
        F.year("o_orderdate").alias(PERIOD),
        F.col("o_orderstatus").alias("grp"),
        F.col("o_totalprice").alias("m1"),
    )


def lines_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, with the return flag, of which there are few, as entity."""
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias(ENTITY),
        F.year("l_shipdate").alias(PERIOD),
        F.col("l_linestatus").alias("grp"),
        F.col("l_extendedprice").alias("m1"),
        F.col("l_quantity").alias("m2"),
    )


# Sources, schema, corrections


def read_raw_text(spark, folder):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return read_raw(spark, f"{folder}/orders.parquet", columns, fmt="parquet")


def read_csv_quarantine(spark, folder):
    """Orders from csv, of which some lines have a field too many and some one too few, and the lines set aside."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    orders = table(spark, folder, "orders")
    more, fewer = F.col("o_orderkey") % 97 == 0, F.col("o_orderkey") % 89 == 0
    fields = [F.col("o_orderkey"), F.col("o_custkey"), F.when(~fewer, F.col("o_orderstatus")), F.when(more, F.lit("x"))]
    lines = F.concat_ws(",", *[f.cast("string") for f in fields])
    paths = [f"{shared_folder(spark)}/{part}-{uuid.uuid4().hex}" for part in ("csv", "aside")]
    orders.select(lines.alias("line")).write.text(paths[0])
    good = read_with_quarantine(spark, paths[0], columns, paths[1], orders.count(), header=False)
    good = good.select(F.concat_ws(",", *columns).alias("line"), F.lit(False).alias("set_aside"))
    return good.union(spark.read.parquet(paths[1]).select("line", F.lit(True)))


def rename_columns(spark, folder):
    names = {"o_orderkey": ID, "o_custkey": ENTITY, "o_orderstatus": "o_orderkey"}
    renamed = ops.rename_columns(table(spark, folder, "orders"), names)
    return renamed.select(ID, ENTITY, "o_orderkey")


def blank_to_null_cast(spark, folder):
    panel = ops.blank_to_null(text_panel(spark, folder), ["grp", "m1", "m2"])
    return rounded(ops.cast_measures(panel, {"m1": "double", "m2": "double", "added": "int"}))


def cast_failures(spark, folder):
    types = {"m1": "decimal(8,2)", "m2": "double", "grp": "int"}
    return ops.cast_failures(text_panel(spark, folder), types)


def missing_audit(spark, folder):
    return ops.missing_audit(text_panel(spark, folder))


def missing_by_entity(spark, folder):
    return ops.missing_by_group(customer_year(spark, folder), ENTITY, "m1")


def distinct_categories(spark, folder):
    return ops.distinct_values(customer_year(spark, folder), "grp")


def apply_corrections(spark, folder):
    """Cells below a third of the customer's mean take the mean, by a join on the row key."""
    panel = stored_customers(spark, folder)
    totals = exact_totals(panel, [ENTITY], {"total": "m1"})
    means = totals.select(ENTITY, exact_mean("total").alias("mean"), rounded_mean("total", 2).alias("rounded"))
    fixes = panel.join(means, ENTITY).select(ID, "m1", "mean", "rounded")
    updates = {"m1": "fix_rounded"}
    return rounded(ops.apply_corrections(panel, fixes, ID, updates, when="fix_m1 < fix_mean / 3"))


def apply_corrections_only_null(spark, folder):
    """Missing amounts of every year take the customer's account balance."""
    panel = stored_customers(spark, folder)
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("bigint").alias(ENTITY), F.col("c_acctbal").alias("balance")
    )
    balances = panel.filter("m1 IS NULL").select(ID, ENTITY).join(customers, ENTITY)
    updates = {"m1": "fix_balance"}
    corrections = balances.select(ID, "balance")
    return rounded(ops.apply_corrections(panel, corrections, ID, updates, only_null=True))


def delete_by_key(spark, folder):
    cheap = table(spark, folder, "orders").filter("o_totalprice < 100000")
    return rounded(
        ops.delete_by_key(
            orders_by_year(spark, folder), cheap.select(F.col("o_orderkey").alias(ID)), ID
        )
    )


def materialized_view(spark, folder):
    """A snapshot under a view name, read back through SQL; the view is dropped afterwards."""
    cells = customer_year(spark, folder).filter("m1 IS NOT NULL")
    materialize(cells, "known_cells")
    counts = spark.sql("SELECT seg, period, count(*) AS n FROM known_cells GROUP BY seg, period")
    drop_materialized(spark, "known_cells")
    return counts


# Fills


def fill_prev_category(spark, folder):
    panel = stored_users(spark, folder)
    return rounded(ops.fill_previous_category(panel, ENTITY, PERIOD, "grp", ID))


def fill_last_seen_category(spark, folder):
    panel = stored_users(spark, folder)
    filled = ops.fill_previous_category(panel, ENTITY, PERIOD, "grp", ID, mode="last_seen")
    return rounded(filled)


def _neighbours(rule: NeighbourRule) -> Query:
    def query(spark, folder):
        panel = stored_customers(spark, folder)
        rules = {"m1": rule, "m2": rule}
        return rounded(ops.fill_neighbours(panel, ENTITY, PERIOD, "seg", rules, ID))

    return query


def _across(method: str) -> Query:
    def query(spark, folder):
        panel = stored_customers(spark, folder)
        return rounded(ops.fill_across(panel, ENTITY, PERIOD, "seg", ["m1", "m2"], method, ID), 4)

    return query


def fill_mean_cascade(spark, folder):
    """Gaps take the user's mean. Every third user has no clicks known and takes the group's mean of the
    day; those known values are blanked here to give the cascade its second step."""
    panel = stored_users(spark, folder)
    sparse = panel.withColumn("m2", F.when(F.col(ENTITY) % 3 != 0, F.col("m2")))
    filled = ops.fill_mean_cascade(sparse, ENTITY, PERIOD, "seg", ["m1", "m2"])
    return rounded(filled)


def fill_median_cascade(spark, folder):
    """As the mean cascade, with the user's median and the group's median of the day."""
    panel = stored_users(spark, folder)
    sparse = panel.withColumn("m2", F.when(F.col(ENTITY) % 3 != 0, F.col("m2")))
    filled = ops.fill_mean_cascade(sparse, ENTITY, PERIOD, "seg", ["m1", "m2"], stat="median")
    return rounded(filled)


# Quality


def dedupe_keyed(spark, folder):
    return rounded(ops.dedupe_keyed(orders_by_year(spark, folder), [ENTITY, PERIOD], ID))


def low_outliers(spark, folder):
    panel = stored_users(spark, folder)
    return rounded(ops.replace_low_outliers(panel, ENTITY, {"m1": 2, "m2": 0}))


def low_outliers_lines(spark, folder):
    lines = lines_by_year(spark, folder)
    repaired = ops.replace_low_outliers(lines, ENTITY, {"m1": 2, "m2": 0})
    return rounded(
        repaired.groupBy(ENTITY, PERIOD).agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2")), 2
    )


def out_of_range(spark, folder):
    panel = stored_users(spark, folder)
    return rounded(ops.replace_out_of_range(panel, ENTITY, {"m1": (15, 40)}))


def derive_ratio(spark, folder):
    panel = user_day(spark, folder)
    return rounded(ops.derive_ratio(panel, "m1", "m2", "ratio"))


PANEL_SPEC = CleaningSpec(
    key=ID,
    entity=ENTITY,
    period=PERIOD,
    group="grp",
    blanks=("grp", "m1", "m2"),
    types={"m1": "double", "m2": "double"},
    previous_category="grp",
    neighbour_fills={"m1": NeighbourRule("adjacent", 2)},
    mean_fills=("m2",),
    low_outliers={"m1": 2},
    ranges={"m2": (1, 3)},
    ratio=Ratio("m2", "m1", "ratio", digits=6),
)


def clean_customer_panel(spark, folder):
    return rounded(clean_panel(pin(text_panel(spark, folder), "raw"), PANEL_SPEC))


# Analysis


def describe_by_entity(spark, folder):
    return rounded(ops.describe_by_group(stored_users(spark, folder), ENTITY, "m1"))


def describe_null_ranks(spark, folder):
    return rounded(ops.describe_by_group(stored_users(spark, folder), ENTITY, "m1", nulls="first"))


def describe_lines(spark, folder):
    return rounded(ops.describe_by_group(lines_by_year(spark, folder), ENTITY, "m1"))


def trend_slope(spark, folder):
    return rounded(ops.trend_slope(stored_customers(spark, folder), ENTITY, PERIOD, "m1"))


def trend_slope_with_group(spark, folder):
    panel = stored_customers(spark, folder)
    return rounded(ops.trend_slope(panel, ENTITY, PERIOD, "m1", carry="grp"))


def trend_slope_pairwise(spark, folder):
    panel = stored_customers(spark, folder)
    return rounded(ops.trend_slope(panel, ENTITY, PERIOD, "m1", pairwise=True))


def trend_slope_lines(spark, folder):
    return rounded(ops.trend_slope(lines_by_year(spark, folder), ENTITY, PERIOD, "m1"), 12)


def stored_panel_profile(spark, folder):
    """Figures and trend of each entity, both from one panel stored by entity."""
    panel = ops.store_by_entity(customer_year(spark, folder), ENTITY, PERIOD, ID)
    described = ops.describe_by_group(panel, ENTITY, "m1")
    return rounded(described.join(ops.trend_slope(panel, ENTITY, PERIOD, "m1"), ENTITY))


def latest_group_mean(spark, folder):
    return rounded(ops.latest_group_mean(customer_year(spark, folder), "grp", PERIOD, "m1"))


def pearson_global(spark, folder):
    panel = customer_year(spark, folder).withColumn("m3", F.col("m1") / F.col("m2"))
    return rounded(ops.pearson(panel, [("m1", "m2"), ("m1", "period"), ("m2", "m3")]))


def pearson_pairwise(spark, folder):
    return rounded(ops.pearson(customer_year(spark, folder), [("m1", PERIOD)], pairwise=True))


def customer_tiers(panel: DataFrame) -> DataFrame:
    return ops.pareto_tiers(panel, ENTITY, "m1", (71, 90), "latest", PERIOD, digits=4)


def pearson_by_tier(spark, folder):
    panel = stored_customers(spark, folder)
    tiers = customer_tiers(panel).filter("tier IN ('high', 'low')").select(ENTITY, "tier")
    pairs = [("m1", "m2"), ("m1", PERIOD), ("m2", PERIOD)]
    return rounded(ops.pearson_by_group(panel.join(tiers, ENTITY), "tier", pairs))


def pareto_tiers_latest(spark, folder):
    return rounded(customer_tiers(customer_year(spark, folder)))


def pareto_tiers_mean(spark, folder):
    panel = user_day(spark, folder)
    return rounded(ops.pareto_tiers(panel, ENTITY, "m2", (81,), "mean", digits=4))


def mean_by_tier(spark, folder):
    panel = stored_customers(spark, folder)
    return rounded(ops.mean_by_tier(panel, customer_tiers(panel), ENTITY, "m1"))


def mean_by_two_tiers(spark, folder):
    panel = stored_customers(spark, folder)
    first = ops.pareto_tiers(panel, ENTITY, "m1", (81,), "mean", out="m1_tier", digits=4)
    second = ops.pareto_tiers(panel, ENTITY, "m2", (61,), "mean", out="m2_tier", digits=4)
    means = ops.mean_by_two_tiers(panel, first, second, ENTITY, "m1", "m1_tier", "m2_tier")
    return rounded(means)


def rows_at_extremes(spark, folder):
    panel = stored_customers(spark, folder)
    return rounded(ops.rows_at_extremes(panel, "m2", [ENTITY, PERIOD, "m1", "m2"]))


def extreme_profile(spark, folder):
    panel = customer_year(spark, folder)
    return rounded(ops.extreme_group_profile(panel, ENTITY, "m2", ["m1", "m2"]))


def rolling_mean_warmup(spark, folder):
    panel = stored_users(spark, folder)
    rolled = ops.rolling_mean(panel, ENTITY, PERIOD, "m1", key=ID)
    return rounded(rolled.select(ID, ENTITY, PERIOD, "moving_avg"))


def rolling_mean_orders(spark, folder):
    orders = orders_by_year(spark, folder)
    rolled = ops.rolling_mean(orders, ENTITY, PERIOD, "m1", preceding=3, warmup=1, key=ID)
    return rounded(rolled.select(ID, ENTITY, PERIOD, "moving_avg"))


def mean_by_region(spark, folder):
    panel = customer_year(spark, folder)
    places = regions(spark, folder, ENTITY)
    return rounded(ops.mean_by_subgroup(panel, places, ENTITY, ["region"], "m1"))


# The same operators straight over the large tables


def gappy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order. Known amounts of pending orders are blanked, so that there are gaps to fill."""
    priority = F.col("o_orderpriority").alias("seg")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(ID),
        F.col("o_custkey").alias(ENTITY),
        F.year("o_orderdate").alias(PERIOD),
        priority,
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("m1"),
    )
    return orders


def lines_by_part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias(ENTITY),
        F.col("l_quantity").alias("m1"),
        F.col("l_extendedprice").alias("m2"),
    )


def fill_adjacent_orders(spark, folder):
    rules = {"m1": NeighbourRule("adjacent", 2)}
    orders = gappy_orders(spark, folder)
    return rounded(ops.fill_neighbours(orders, ENTITY, PERIOD, "seg", rules, ID))


def fill_first_value_orders(spark, folder):
    rules = {"m1": NeighbourRule("first_value")}
    orders = gappy_orders(spark, folder)
    return rounded(ops.fill_neighbours(orders, ENTITY, PERIOD, "seg", rules, ID))


def fill_mean_cascade_orders(spark, folder):
    filled = ops.fill_mean_cascade(gappy_orders(spark, folder), ENTITY, PERIOD, "seg", ["m1"])
    return filled.withColumn("m1", round_half_up(F.col("m1"), 2))


def out_of_range_orders(spark, folder):
    orders = orders_by_year(spark, folder)
    return rounded(ops.replace_out_of_range(orders, ENTITY, {"m1": (100000, 300000)}))


def describe_orders(spark, folder):
    return rounded(ops.describe_by_group(gappy_orders(spark, folder), ENTITY, "m1"))


def describe_orders_null_ranks(spark, folder):
    orders = gappy_orders(spark, folder)
    return rounded(ops.describe_by_group(orders, ENTITY, "m1", nulls="first"))


def pearson_lines(spark, folder):
    lines = table(spark, folder, "lineitem")
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    return rounded(ops.pearson(lines, pairs))


def pearson_lines_by_flag(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(ops.pearson_by_group(lines, "l_returnflag", [("l_quantity", "l_extendedprice")]))


def pareto_tiers_parts(spark, folder):
    lines = lines_by_part(spark, folder)
    return rounded(ops.pareto_tiers(lines, ENTITY, "m2", (71, 90), "mean", digits=4))


def pareto_tiers_orders(spark, folder):
    """Every order an entity, so that most rounded shares would be 0; running shares of the amounts themselves."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(ENTITY), F.year("o_orderdate").alias(PERIOD), F.col("o_totalprice").alias("m1")
    )
    return rounded(ops.pareto_tiers(orders, ENTITY, "m1", (71, 90), "latest", PERIOD), 9)


def mean_by_tier_parts(spark, folder):
    lines = lines_by_part(spark, folder)
    tiers = ops.pareto_tiers(lines, ENTITY, "m2", (71, 90), "mean", position=False, digits=4)
    return rounded(ops.mean_by_tier(lines, tiers, ENTITY, "m1"))


def extreme_profile_parts(spark, folder):
    return rounded(ops.extreme_group_profile(lines_by_part(spark, folder), ENTITY, "m1", ["m2"]))


def rows_at_extremes_lines(spark, folder):
    lines = table(spark, folder, "lineitem")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return ops.rows_at_extremes(lines, "l_quantity", columns)


def running_amount(spark, folder):
    """Running total of each customer's order amounts by order key."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias(ENTITY),
        F.col("o_orderkey").alias(ID),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
    )
    totals = ops.running_totals(orders, [ENTITY], [ID], {"running": F.col("amount")})
    return rounded(totals.select(ENTITY, ID, "running"), 2)


# The health panel: raw table, cleaning and questions


def health_audit(spark, folder):
    return health.audit_health_panel(health_staging(spark, folder))


def health_missing_gdp(spark, folder):
    return health.missing_gdp(health_staging(spark, folder))


def stored_staging(spark: SparkSession, folder: str) -> DataFrame:
    return pin(health_staging(spark, folder), "staging")


def health_clean(spark, folder):
    return rounded(health.clean_health_panel(stored_staging(spark, folder)))


def clean_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned health panel as a written table, which the questions read."""
    return pin(health.clean_health_panel(stored_staging(spark, folder)), "health")


def _question(ask: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(ask(clean_snapshot(spark, folder)))


def health_life_expectancy_by_region(spark, folder):
    places = regions(spark, folder, "country")
    places = places.select(F.col("country").cast("string").alias("Country"), "region")
    return rounded(health.life_expectancy_by_region(clean_snapshot(spark, folder), places))


QUERIES: dict[str, Query] = {
    "read_raw_text": read_raw_text,
    "read_csv_quarantine": read_csv_quarantine,
    "rename_columns": rename_columns,
    "blank_to_null_cast": blank_to_null_cast,
    "cast_failures": cast_failures,
    "missing_audit": missing_audit,
    "missing_by_entity": missing_by_entity,
    "distinct_categories": distinct_categories,
    "apply_corrections": apply_corrections,
    "apply_corrections_only_null": apply_corrections_only_null,
    "delete_by_key": delete_by_key,
    "materialized_view": materialized_view,
    "fill_prev_category": fill_prev_category,
    "fill_last_seen_category": fill_last_seen_category,
    "fill_first_value": _neighbours(NeighbourRule("first_value")),
    "fill_lead_then_last": _neighbours(NeighbourRule("lead_then_last", 2)),
    "fill_adjacent": _neighbours(NeighbourRule("adjacent", 2)),
    "fill_nearest": _across("nearest"),
    "fill_linear": _across("linear"),
    "fill_mean_cascade": fill_mean_cascade,
    "fill_median_cascade": fill_median_cascade,
    "dedupe_keyed": dedupe_keyed,
    "low_outliers": low_outliers,
    "low_outliers_lines": low_outliers_lines,
    "out_of_range": out_of_range,
    "derive_ratio": derive_ratio,
    "clean_panel": clean_customer_panel,
    "describe_by_entity": describe_by_entity,
    "describe_null_ranks": describe_null_ranks,
    "describe_lines": describe_lines,
    "trend_slope": trend_slope,
    "trend_slope_with_group": trend_slope_with_group,
    "trend_slope_pairwise": trend_slope_pairwise,
    "trend_slope_lines": trend_slope_lines,
    "stored_panel_profile": stored_panel_profile,
    "latest_group_mean": latest_group_mean,
    "pearson_global": pearson_global,
    "pearson_pairwise": pearson_pairwise,
    "pearson_by_tier": pearson_by_tier,
    "pareto_tiers_latest": pareto_tiers_latest,
    "pareto_tiers_mean": pareto_tiers_mean,
    "mean_by_tier": mean_by_tier,
    "mean_by_two_tiers": mean_by_two_tiers,
    "rows_at_extremes": rows_at_extremes,
    "extreme_profile": extreme_profile,
    "rolling_mean_warmup": rolling_mean_warmup,
    "rolling_mean_orders": rolling_mean_orders,
    "mean_by_region": mean_by_region,
    "running_amount": running_amount,
    "fill_adjacent_orders": fill_adjacent_orders,
    "fill_first_value_orders": fill_first_value_orders,
    "fill_mean_cascade_orders": fill_mean_cascade_orders,
    "out_of_range_orders": out_of_range_orders,
    "describe_orders": describe_orders,
    "describe_orders_null_ranks": describe_orders_null_ranks,
    "pearson_lines": pearson_lines,
    "pearson_lines_by_flag": pearson_lines_by_flag,
    "pareto_tiers_parts": pareto_tiers_parts,
    "pareto_tiers_orders": pareto_tiers_orders,
    "mean_by_tier_parts": mean_by_tier_parts,
    "extreme_profile_parts": extreme_profile_parts,
    "rows_at_extremes_lines": rows_at_extremes_lines,
    "health_audit": health_audit,
    "health_missing_gdp": health_missing_gdp,
    "health_clean": health_clean,
    "health_gdp_tiers": _question(health.gdp_tiers),
    "health_measles_tiers": _question(health.measles_tiers),
    "health_polio_tiers": _question(health.polio_tiers),
    **{f"health_{name}": _question(ask) for name, ask in health.QUESTIONS.items()},
    "health_life_expectancy_by_region": health_life_expectancy_by_region,
}
