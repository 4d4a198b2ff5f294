"""Exact sums, medians from sketches, and running shares in ranges."""

import math
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from panelweave import describe_by_group, pareto_tiers
from panelweave.functions import (
    exact_mean,
    exact_midpoint,
    exact_totals,
    merged_totals,
    rounded_mean,
    total_as_double,
)
from panelweave.operators import summary

KINDS = {
    "cents": lambda rng: round(rng.uniform(-1e6, 1e6), 2),
    "count": lambda rng: float(rng.randrange(10)),
    "long": lambda rng: rng.uniform(0, 100),
    "large": lambda rng: round(rng.uniform(-1e11, 1e11), 2),
    "mixed": lambda rng: rng.uniform(-1, 1) * 10.0 ** rng.randrange(-5, 11),
}


def values(seed=1):
    rng = random.Random(seed)
    return {
        f"{kind}{n}": [make(rng) for _ in range(n)] for kind, make in KINDS.items() for n in (1, 2, 3, 7, 200)
    }


def means(spark, rows, partitions):
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    totals = exact_totals(df, ["g"], {"t": "v"})
    return {
        r.g: (r.m, r.r, r.s)
        for r in totals.select("g", exact_mean("t").alias("m"), rounded_mean("t", 2).alias("r"), total_as_double("t").alias("s")).collect()
    }


def test_means_are_exact_and_the_same_in_any_order(spark):
    groups = values()
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    first = means(spark, rows, 1)
    assert first == means(spark, random.Random(2).sample(rows, len(rows)), 7)
    for g, vs in groups.items():
        total = sum(Decimal(repr(v)) for v in vs)
        mean = total / len(vs)
        assert first[g][0] == pytest.approx(float(mean), rel=1e-15, abs=1e-17)
        assert first[g][1] == float(mean.quantize(Decimal("0.01"), ROUND_HALF_UP))
        assert first[g][2] == pytest.approx(float(total), rel=1e-15, abs=1e-16)


def test_sums_of_what_does_not_fit(spark):
    rows = [("huge", 1e300), ("huge", 2e300), ("inf", math.inf), ("inf", 1.0), ("nan", math.nan), ("nan", 1.0)]
    rows += [("tiny", 1e-30), ("tiny", 3e-30), ("none", None)]
    got = means(spark, rows, 3)
    assert got["huge"][0] == 1.5e300 and got["inf"][0] == math.inf and math.isnan(got["nan"][0])
    assert got["tiny"][0] == pytest.approx(2e-30) and got["none"] == (None, None, None)


def test_decimals_integers_and_merged_totals(spark):
    df = spark.createDataFrame([(i % 3, i, i / 100) for i in range(30)], "g int, n long, v double")
    df = df.withColumn("d", F.col("v").cast("decimal(6,2)"))
    totals = exact_totals(df, ["g"], {"n": "n", "v": "v", "d": "d"})
    whole = totals.agg(*[merged_totals(F.col(c)).alias(c) for c in ("n", "v", "d")])
    row = whole.select(*[exact_mean(c).alias(c) for c in ("n", "v", "d")]).first()
    assert tuple(row) == (14.5, 0.145, 0.145)


def test_midpoints_are_rounded_as_decimals(spark):
    df = spark.createDataFrame([(1.01, 1.02), (0.57, 0.58), (1.0, None), (-0.01, -0.02)], "a double, b double")
    dtype = df.schema["a"].dataType
    got = [r[0] for r in df.select(exact_midpoint(F.col("a"), F.col("b"), dtype, 2)).collect()]
    assert got == [1.02, 0.58, None, -0.02]


@pytest.mark.parametrize("kept", [2000, 0])
@pytest.mark.parametrize("nulls", ["skip", "first"])
def test_medians_from_sketches_and_from_brackets(spark, monkeypatch, kept, nulls):
    monkeypatch.setattr(summary, "KEPT_VALUES", kept)
    rng = random.Random(kept)
    rows = [(n, round(rng.gauss(0, 50), 1)) for n in range(1, 60) for _ in range(n)]
    rows += [(n, None) for n in range(0, 60, 3) for _ in range(n % 5 + 1)]
    rows += [(99, float(rng.randrange(40_000))) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    for r in describe_by_group(df, "g", "v", nulls).collect():
        vs = sorted(v for g, v in rows if g == r.g and v is not None)
        if nulls == "skip":
            expected = statistics.median(vs) if vs else None
        else:
            ranked = [None] * sum(g == r.g and v is None for g, v in rows) + vs
            middle = [ranked[i - 1] for i in ((len(vs) + 1) // 2, (len(vs) + 2) // 2) if i]
            middle = [v for v in middle if v is not None]
            expected = statistics.fmean(middle) if middle else None
        assert r["median"] == (None if expected is None else pytest.approx(expected, abs=0.00501)), r.g


def test_a_bracket_that_misses_is_counted_in_full(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(101)], "g string, v double")
    monkeypatch.setattr(summary, "KEPT_VALUES", 0)
    wrong = [F.lit(90.0).alias("_from"), F.when(F.col("g") == "a", 95.0).alias("_to")]
    monkeypatch.setattr(summary, "_bracket", lambda: wrong)
    got = describe_by_group(df, "g", "v").collect()
    assert sorted((r.g, r["median"]) for r in got) == [("a", 50.0), ("b", 50.0)]


def test_running_shares_of_many_entities_end_at_100(spark):
    df = spark.range(300_000).select("id", (F.col("id") % 977 + 0.01).alias("v"), F.lit(1).alias("period"))
    tiers = pareto_tiers(df, "id", "v", (71, 90), "latest", "period")
    plan = tiers._jdf.queryExecution().optimizedPlan().toString()
    low, high, last, n = tiers.agg(
        F.min("rolling_percent"), F.max("rolling_percent"), F.max("counting"), F.count_distinct("tier")
    ).first()
    assert 0 < low < 1 and high == 100.0 and last == 300_000 and n == 3
    # Windows over whole entities or shares would need one task: every window is over a range.
    assert "Window" in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_chunk" in line


def test_running_shares_against_plain_sums(spark):
    rng = random.Random(4)
    amounts = [round(rng.uniform(0, 100), 2) for _ in range(200)] + [5.0] * 9
    rows = [(i, 1, v) for i, v in enumerate(amounts)] + [(500, 1, None)]
    df = spark.createDataFrame(rows, "e int, period int, v double")
    total = sum(Decimal(str(v)) for v in amounts)
    for r in pareto_tiers(df, "e", "v", (50,), "latest", "period").collect():
        own = 0 if r.e == 500 else amounts[r.e]
        upto = total if r.e == 500 else sum(Decimal(str(v)) for v in amounts if v >= own)
        assert r.rolling_percent == pytest.approx(float(upto / total * 100), rel=1e-14)
        assert r.tier == ("high" if upto / total * 100 < 50 else "low")
