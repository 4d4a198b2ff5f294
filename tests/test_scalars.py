"""Rounding and comparisons at the edges."""

import pytest
from pyspark.sql import functions as F

from panelweave.functions import in_range, round_half_up


@pytest.mark.parametrize(
    "value, digits, expected",
    [
        (2.4999996, 0, 2.0),
        (1.004999996, 2, 1.0),
        (1.015, 2, 1.02),
        (2.5, 0, 3.0),
        (-2.5, 0, -3.0),
        (0.285, 2, 0.29),
        (123456.785, 2, 123456.79),
        (100000000000.25, 2, 100000000000.25),
        (1e300, 2, 1e300),
        (None, 2, None),
    ],
)
def test_round_half_up(spark, value, digits, expected):
    row = spark.createDataFrame([(value,)], "v double").select(round_half_up(F.col("v"), digits)).first()
    assert row[0] == expected


def test_given_bounds_are_exact(spark):
    df = spark.createDataFrame([(40.00000000001,), (40.0,)], "v double")
    assert [r[0] for r in df.select(in_range(F.col("v"), 15, 40)).collect()] == [False, True]
