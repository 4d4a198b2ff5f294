"""Panels derived from the order and event tables, used by the registered queries and the bench.

The dense panels hold one row per entity and period, with gaps where nothing happened. Periods come
from a sequence between the first and the last one, so no table is crossed with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per customer and year: last status, amount and number."""
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_custkey").cast("bigint").alias("entity"),
            F.year("o_orderdate").alias("period"),
        )
        .agg(
            # Letters as numbers keep the aggregation hash-based.
            F.chr(F.max_by(F.ascii("o_orderstatus"), "o_orderkey")).alias("grp"),
            F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("m1"),
            F.count(F.lit(1)).cast("double").alias("m2"),
        )
    )


def customer_year(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by year: row_id, entity, period, seg (never NULL), grp, m1, m2 (NULL in gaps)."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("bigint").alias("entity"), F.col("c_mktsegment").alias("seg")
    )
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("period"))
    return _dense(customers, years, order_cells(spark, folder))


def user_day(spark: SparkSession, folder: str) -> DataFrame:
    """Users by day: as :func:`customer_year`, where m2 (clicks) is often 0."""
    events = table(spark, folder, "events")
    day = F.day("ts").alias("period")
    users = events.select(F.col("user_id").alias("entity")).distinct()
    users = users.withColumn("seg", F.concat(F.lit("S"), F.col("entity") % 4))
    cells = events.groupBy(F.col("user_id").alias("entity"), day).agg(
        F.max_by("event_type", "event_id").alias("grp"),
        F.sum(F.col("value").cast(MONEY)).cast("double").alias("m1"),
        F.count_if(F.col("event_type") == "click").cast("double").alias("m2"),
    )
    return _dense(users, events.select(day), cells)


def _dense(entities: DataFrame, periods: DataFrame, cells: DataFrame) -> DataFrame:
    spine = _by_period(entities, periods)
    row_id = F.col("entity") * 10000 + F.col("period")
    return spine.join(cells, ["entity", "period"], "left").select(
        row_id.alias("row_id"), "entity", "period", "seg", "grp", "m1", "m2"
    )


def _by_period(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Entities with one row for each period; to be joined by sorting.

    The planner takes these rows for as few bytes as the entities' files have, and would broadcast millions of them.
    """
    first = periods.agg(F.min("period")).scalar()
    last = periods.agg(F.max("period")).scalar()
    spine = entities.withColumn("_first", first).withColumn("_last", last)
    period = F.explode(F.sequence("_first", "_last")).alias("period")
    return spine.select(*entities.columns, period).hint("merge")


def health_staging(spark: SparkSession, folder: str) -> DataFrame:
    """A raw health panel, all text with blanks, whose measures come from the order lines.

    Customers stand for countries. A customer's urgent and other orders of a year are separate
    rows, so keys repeat; years without orders are blank. Some known values are blanked too, so that every
    column has gaps to fill.
    """
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("country"),
        F.year("o_orderdate").alias("period"),
        F.when(F.col("o_orderpriority") < "3", 1).otherwise(0).alias("urgent"),
        F.ascii("o_orderstatus").alias("status"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("off"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line"),
    )
    cells = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("country", "period", "urgent")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("qty").alias("q"),
            F.min("qty").alias("q_min"),
            F.sum("price").alias("amount"),
            F.sum("off").alias("off"),
            F.max("off").alias("off_max"),
            F.sum("tax").alias("tax"),
            F.count_if(F.col("flag") == "R").alias("returned"),
            F.count_if(F.col("flag") == "A").alias("accepted"),
            F.count_if(F.col("line") == "O").alias("open"),
            F.max("status").alias("status"),
        )
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("country"), F.col("c_mktsegment").alias("seg")
    )
    rows = _by_period(customers, orders.select("period")).join(
        cells, ["country", "period"], "left"
    )
    q, n = F.col("q"), F.col("n")
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    life = (F.floor(q * 100 / n) + 4000).cast("decimal(10,0)") * hundredth
    status = F.when(F.col("status") == ord("F"), "Developed").when(
        F.col("status") == ord("O"), "Developing"
    )
    spent = F.floor("amount").cast("decimal(18,0)") * hundredth
    row_id = F.col("country") * 100000 + F.col("period") * 10 + F.coalesce("urgent", F.lit(0))
    return rows.select(
        _text(F.col("country")).alias("Country"),
        _text(F.col("period")).alias("Year"),
        _text(status).alias("Status"),
        _text(life.cast("decimal(4,2)"), q % 7 != 0).alias("Lifeexpectancy"),
        _text(q, q % 5 != 0).alias("AdultMortality"),
        _text(F.col("returned"), q % 6 != 0).alias("infantdeaths"),
        _text(spent, q % 8 != 0).alias("percentageexpenditure"),
        _text(F.col("open") * 10, F.col("seg") != "HOUSEHOLD").alias("Measles"),
        _text(q % 40 + 8, q % 9 != 0).alias("BMI"),
        _text(F.col("returned") + F.col("accepted")).alias("under-fivedeaths"),
        _text(q % 70 + 5, q % 11 != 0).alias("Polio"),
        _text(F.col("q_min") * 2).alias("Diphtheria"),
        _text(F.col("tax")).alias("HIVAIDS"),
        _text(F.col("amount"), q % 4 != 0).alias("GDP"),
        _text(F.col("off_max")).alias("thinness1-19years"),
        _text(F.col("off"), q % 3 != 0).alias("thinness5-9years"),
        _text(n + 5, q % 10 != 0).alias("Schooling"),
        _text(row_id).alias("Row_ID"),
    )


def _text(value: Column, known: Column | None = None) -> Column:
    """``value`` as text, blank where it is NULL or not ``known``."""
    if known is not None:
        value = F.when(known, value)
    return F.coalesce(value.cast("string"), F.lit(""))


def regions(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Region name per customer, with the customer key named ``key``."""
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias(key), F.col("r_name").alias("region"))
    )
