import math
from decimal import Decimal

import pytest
from conftest import by_entity
from pyspark.sql import functions as F

from panelweave import (
    describe_by_group,
    extreme_group_profile,
    latest_group_mean,
    mean_by_subgroup,
    mean_by_tier,
    mean_by_two_tiers,
    pareto_tiers,
    pearson,
    pearson_by_group,
    replace_out_of_range,
    rolling_mean,
    rows_at_extremes,
    running_totals,
    trend_slope,
)


def test_describe(series, layout):
    panel = series({"E": [1.0, 2.0, None, 4.0, 8.0], "F": [8.0, 1.0, 4.0, 2.0], "G": [None, None]})
    rows = {r.entity: tuple(r)[1:] for r in describe_by_group(panel, "entity", "v").collect()}
    assert rows == {
        "E": (3.75, 1, 8, 3.0),
        "F": (3.75, 1, 8, 3.0),
        "G": (None, None, None, None),
    }
    ranked = describe_by_group(panel, "entity", "v", nulls="first").collect()
    assert {r.entity: r["median"] for r in ranked} == {"E": 1.5, "F": 3.0, "G": None}


def test_describe_repeated_values(series, layout):
    panel = series({"E": [3.0] * 5 + [7.0] * 5, "F": [2.0] * 6})
    medians = {r.entity: r["median"] for r in describe_by_group(panel, "entity", "v").collect()}
    assert medians == {"E": 5.0, "F": 2.0}


def test_trend(series, layout):
    values = [2.0, None, 5.0, 9.0]
    panel = series({"E": values, "F": [4.0], "G": [3.0, 3.0, 3.0], "H": [5.0, 4.0]})
    mean = 16 / 3
    got = {r.entity: r for r in trend_slope(panel, "entity", "period", "v").collect()}
    assert got["E"].slope * mean == pytest.approx(2.0667, abs=1e-4)
    assert (got["E"].trend, got["H"].trend) == ("increase", "decrease")
    assert got["F"].slope is None and got["F"].trend == "not enough data to detect"
    assert got["G"].trend == "not enough data to detect"
    pairwise = {r.entity: r for r in trend_slope(panel, "entity", "period", "v", pairwise=True).collect()}
    assert pairwise["E"].slope * mean == pytest.approx(2.2143, abs=1e-4)


def test_trend_carries_every_category(series):
    panel = series({"E": [1.0, 2.0, 3.0]}).withColumn("s", F.when(F.col("period") > 1, "x"))
    rows = trend_slope(panel, "entity", "period", "v", carry="s").collect()
    assert sorted((r.s or "", r.trend) for r in rows) == [("", "increase"), ("x", "increase")]


def test_trend_ranks_tie(spark):
    rows = [("E", 1, 1.0), ("E", 1, 3.0), ("E", 2, 4.0)]  # ranks 1, 1, 3
    df = spark.createDataFrame(rows, "entity string, period int, v double")
    mean, x = 8 / 3, [1 - 5 / 3, 1 - 5 / 3, 3 - 5 / 3]
    y = [1 / mean - 1, 3 / mean - 1, 4 / mean - 1]
    expected = sum(a * b for a, b in zip(x, y)) / sum(a * a for a in x)
    assert trend_slope(df, "entity", "period", "v").first().slope == pytest.approx(expected)


def test_latest_group_mean(spark):
    rows = [("a", 1, 5.0), ("a", 2, 7.0), ("a", 2, 8.0), ("b", 1, 3.2), (None, 9, 1.0), ("c", 1, 4.0), ("c", 2, None)]
    df = spark.createDataFrame(rows, "g string, p int, v double")
    got = {r.g: r.latest_average for r in latest_group_mean(df, "g", "p", "v").collect()}
    assert got == {"a": 8.0, "b": 3.0, None: 1.0, "c": None}


def test_pearson(spark):
    rows = [(1.0, 2.0, 3.0), (2.0, None, 3.0), (3.0, 5.0, 3.0), (None, 7.0, 3.0), (5.0, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    literal = pearson(df, [("x", "y"), ("x", "c")]).first()
    assert literal.corr_x_y == pytest.approx(0.8946603953)
    assert literal.corr_x_c is None
    pairwise = pearson(df, [("x", "y"), ("x", "c")], pairwise=True).first()
    assert pairwise.corr_x_y == pytest.approx(0.9966158955)
    assert pairwise.corr_x_c is None
    # Large means do not cancel.
    far = df.select((F.col("x") + 1e9).alias("x"), (F.col("y") + 1e9).alias("y"))
    assert pearson(far, [("x", "y")]).first()[0] == pytest.approx(0.8946603953, abs=1e-6)
    grouped = pearson_by_group(df.withColumn("g", F.lit("k")), "g", [("x", "y")]).first()
    assert grouped.corr_x_y == pytest.approx(0.8946603953)


def shares(spark, values):
    df = spark.createDataFrame([(k, 1, v) for k, v in values.items()], "e string, p int, v double")
    tiers = pareto_tiers(df, "e", "v", (71, 90), "latest", "p")
    return {r.e: (r.tier, r.counting) for r in tiers.collect()}


def test_tiers(spark, layout):
    assert shares(spark, {"A": 70.0, "B": 1.0, "C": 19.0, "D": 10.0}) == {
        "A": ("high", 1),
        "C": ("medium", 2),
        "D": ("low", 3),
        "B": ("low", 4),
    }
    exact = shares(spark, {"A": 71.0, "C": 19.0, "D": 10.0})
    assert {k: t for k, (t, _) in exact.items()} == {"A": "medium", "C": "low", "D": "low"}
    tied = shares(spark, {"A": 60.0, "B": 20.0, "C": 20.0, "Z": None})
    assert tied == {"A": ("high", 1), "B": ("low", 2), "C": ("low", 3), "Z": ("low", 4)}
    negative = shares(spark, {"A": 100.0, "B": -20.0, "C": 20.0})
    assert {k: t for k, (t, _) in negative.items()} == {"A": "low", "B": "low", "C": "low"}


def test_tiers_use_latest_or_mean(spark):
    rows = [("A", 1, 90.0), ("A", 2, 10.0), ("B", 1, 20.0), ("B", 2, 90.0), ("C", 1, 5.0), ("C", 2, None)]
    df = spark.createDataFrame(rows, "e string, p int, v double")
    latest = {r.e: r.percent_in_total for r in pareto_tiers(df, "e", "v", (71, 90), period="p").collect()}
    assert latest == {"A": 10, "B": 90, "C": None}
    mean = {r.e: r.percent_in_total for r in pareto_tiers(df, "e", "v", (81,), "mean", digits=4).collect()}
    assert mean == {"A": Decimal("45.4545"), "B": 50, "C": Decimal("4.5455")}
    with pytest.raises(ValueError):
        pareto_tiers(df, "e", "v", (71,), "latest")
    with pytest.raises(ValueError):
        pareto_tiers(df, "e", "v", (1, 2, 3), "mean")


def test_means_over_tiers(spark):
    rows = [("A", 1.0), ("A", 3.0), ("A", None), ("B", 8.0), ("C", 100.0)]
    df = spark.createDataFrame(rows, "e string, v double")
    first = spark.createDataFrame([("A", "x"), ("B", "x")], "e string, t string")
    second = spark.createDataFrame([("A", "p"), ("B", "q")], "e string, u string")
    assert mean_by_tier(df, first, "e", "v", "t").first().avg_v == 4.0
    both = mean_by_two_tiers(df, first, second, "e", "v", "t", "u").collect()
    assert [tuple(r) for r in both] == [("x", "q", 8.0), ("x", "p", 2.0)]
    dim = spark.createDataFrame([("A", "N"), ("C", "N"), ("B", "S")], "e string, r string")
    regions = mean_by_subgroup(df, dim, "e", ["r"], "v").collect()
    assert {r.r: r.avg_v for r in regions} == {"N": pytest.approx(104 / 3), "S": 8.0}


def test_extremes(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("b", 1.0, 4.0), ("c", 9.0, 6.0), ("d", 5.0, None), ("e", None, 1.0)],
        "e string, v double, w double",
    )
    assert sorted(r.e for r in rows_at_extremes(df, "v", ["e"]).collect()) == ["a", "b", "c"]
    profile = extreme_group_profile(df, "e", "v", ["w"]).collect()
    assert {(r.e, r.ranking, r.avg_w) for r in profile} == {
        ("a", "lowest_expectancy", 2.0),
        ("b", "lowest_expectancy", 4.0),
        ("c", "highest_expectancy", 6.0),
    }
    # As doubles, (0.1 + 0.2 + 0.3) / 3 is above 0.2. What is above it in truth is no tie.
    rows = [("a", 0.2), ("b", 0.1), ("b", 0.2), ("b", 0.3), ("c", 0.9), ("d", 0.20000000000000004)]
    noisy = spark.createDataFrame([(*r, 1.0) for r in rows], "e string, v double, w double")
    lowest = extreme_group_profile(noisy, "e", "v", ["w"]).filter("ranking LIKE 'low%'")
    assert sorted(r.e for r in lowest.collect()) == ["a", "b"]
    flat = extreme_group_profile(df.filter("v = 1"), "e", "v", ["w"]).collect()
    assert {r.ranking for r in flat} == {"lowest_expectancy"}


def test_rolling(series, layout, spark):
    panel = series({"E": [float(v) for v in range(1, 9)]}, start=2000)
    rolled = rolling_mean(panel, "entity", "period", "v", key="row_id")
    assert by_entity(rolled, "moving_avg") == {"E": [0, 0, 0, 0, 3, 3.5, 4.5, 5.5]}
    rows = [(1, "G", 2000, 3.0), (2, "G", 2003, 6.0), (3, "G", 2005, 9.0), (4, "G", 2006, None)]
    gaps = spark.createDataFrame(rows, "row_id long, entity string, period int, v double")
    rolled = rolling_mean(gaps, "entity", "period", "v", key="row_id")
    assert by_entity(rolled, "moving_avg") == {"G": [0, 0, 6, 6]}


def test_running_totals(spark, layout):
    rows = [(k, i, Decimal(i)) for k in ("a", None) for i in range(7)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, d decimal(12,4)")
    got = running_totals(df, ["k"], ["-i"], {"t": F.col("d")}).collect()
    totals = {(r.k, r.i): r.t for r in got}
    assert totals.pop(("b", 0)) is None
    assert totals == {(k, i): sum(range(i, 7)) for k in ("a", None) for i in range(7)}
    overall = running_totals(df.filter("k = 'a'"), [], ["i"], {"t": F.col("d")}).collect()
    assert {r.i: r.t for r in overall} == {i: math.comb(i + 1, 2) for i in range(7)}


def test_trend_of_a_tiny_slope_and_of_a_flat_series(spark):
    n = 2000
    rows = [("up", i, 1.0 + 1e-9 * i) for i in range(n)] + [("flat", i, 0.1 + 0.2) for i in range(n)]
    rows += [("down", i, 7.0 - 1e-9 * i) for i in range(n)] + [("wave", i, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "entity string, period int, v double")
    found = {r.entity: r.trend for r in trend_slope(df, "entity", "period", "v").collect()}
    assert found == {"up": "increase", "flat": "not enough data to detect", "down": "decrease", "wave": "not enough data to detect"}


def test_shares_of_many_entities(spark):
    df = spark.range(1, 3_000_001).select(F.col("id").alias("entity"), F.col("id").cast("double").alias("v"))
    end = pareto_tiers(df, "entity", "v", (71, 90), stat="mean").agg(F.max("rolling_percent"))
    assert end.first()[0] == 100.0
    df = df.filter("entity <= 300000")
    tiers = pareto_tiers(df, "entity", "v", (71, 90), stat="mean", digits=12, position=False)
    row = tiers.agg(F.max("rolling_percent").alias("end"), F.avg((F.col("tier") == "high").cast("int")).alias("high")).first()
    assert abs(float(row.end) - 100) < 1e-4 and abs(row.high - 0.46) < 0.01


def test_range_bounds_are_exact(spark, series):
    df = series({"a": [20.0, 40.00000000001, 40.0]})
    fixed = replace_out_of_range(df, "entity", {"v": (15, 40)})
    assert by_entity(fixed)["a"] == [20.0, 30.0, 40.0]
