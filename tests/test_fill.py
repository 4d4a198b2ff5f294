from decimal import Decimal

import pytest
from conftest import by_entity

from panelweave import (
    NeighbourRule,
    fill_across,
    fill_mean_cascade,
    fill_neighbours,
    fill_previous_category,
)

GAPS = {
    "N1": [None, 10.0, None, None, 20.0, None],
    "N2": [5.0, 10.0, None, None, 20.0, 30.0],
    "N3": [1.0, None, 3.0, None, None, None, 7.0],
    "N4": [40.0, 41.0, 42.0, 43.0, 44.0, 45.0, 46.0],
}
SEG = {"N1": "X", "N2": "Y", "N3": "A", "N4": "A"}
FILLED = {
    "first_value": {
        "N1": [None, 10, None, None, 20, None],
        "N2": [5, 10, 30, 5, 20, 30],
        "N3": [1, 2, 3, 7, 44, 1, 7],
        "N4": GAPS["N4"],
    },
    "lead_then_last": {
        "N1": [10, 10, None, 20, 20, None],
        "N2": [5, 10, 30, 20, 20, 30],
        "N3": [1, 2, 3, 7, 44, 7, 7],
        "N4": GAPS["N4"],
    },
    "adjacent": {
        "N1": [10, 10, 10, 20, 20, 20],
        "N2": [5, 10, 10, 20, 20, 30],
        "N3": [1, 2, 3, 3, 44, 7, 7],
        "N4": GAPS["N4"],
    },
}


@pytest.mark.parametrize("edge", FILLED)
def test_neighbour_rules(series, layout, edge):
    filled = fill_neighbours(
        series(GAPS, SEG), "entity", "period", "seg", {"v": NeighbourRule(edge)}, "row_id"
    )
    assert filled.columns == ["row_id", "entity", "seg", "period", "v"]
    assert by_entity(filled) == FILLED[edge]


def test_neighbour_digits_and_storage_type(series):
    halves = {"E": [1.01, None, 1.02], "F": [None, None, None], "G": [2.0, 2.005, 2.0]}
    rule = {"v": NeighbourRule("adjacent", 2)}
    filled = by_entity(fill_neighbours(series(halves), "entity", "period", "seg", rule, "row_id"))
    assert filled["E"] == [1.01, 1.02, 1.02]
    assert filled["F"] == [1.51, 2.01, 1.51]  # group means, from which 2.005 rounds up
    panel = series({"E": [Decimal("1.01"), None, Decimal("1.02")]}, dtype="decimal(4,2)")
    filled = fill_neighbours(panel, "entity", "period", "seg", {"v": NeighbourRule()}, "row_id")
    assert by_entity(filled)["E"][1] == Decimal("1.02")
    assert filled.schema["v"].dataType.simpleString() == "decimal(4,2)"


def test_null_group_has_a_mean_of_its_own(spark):
    rows = [(1, "a", None, 1, None), (2, "b", None, 1, 6.0), (3, "c", "G", 1, 1.0)]
    panel = spark.createDataFrame(
        rows, "row_id long, entity string, seg string, period int, v double"
    )
    rule = {"v": NeighbourRule()}
    filled = by_entity(fill_neighbours(panel, "entity", "period", "seg", rule, "row_id"))
    assert filled["a"] == [6.0]
    assert by_entity(fill_mean_cascade(panel, "entity", "period", "seg", ["v"]))["a"] == [6.0]


def test_previous_category(series, layout):
    panel = series({"E": ["A", None, None, "B", None], "F": [None, "C"]}, dtype="string")
    one = fill_previous_category(panel, "entity", "period", "v", "row_id")
    assert by_entity(one) == {"E": ["A", "A", None, "B", "B"], "F": [None, "C"]}
    seen = fill_previous_category(panel, "entity", "period", "v", "row_id", mode="last_seen")
    assert by_entity(seen) == {"E": ["A", "A", "A", "B", "B"], "F": [None, "C"]}


ACROSS = {
    "nearest": {
        "N1": [10, 10, 10, 20, 20, 20],
        "N2": [5, 10, 10, 20, 20, 30],
        "N3": [1, 1, 3, 3, 3, 7, 7],
        "N4": GAPS["N4"],
    },
    "linear": {
        "N1": [10, 10, 40 / 3, 50 / 3, 20, 20],
        "N2": [5, 10, 40 / 3, 50 / 3, 20, 30],
        "N3": [1, 2, 3, 4, 5, 6, 7],
        "N4": GAPS["N4"],
    },
}


@pytest.mark.parametrize("method", ACROSS)
def test_gaps_filled_across_runs(series, layout, method):
    panel = series({**GAPS, "N5": [None, None]}, {**SEG, "N5": "A"})
    filled = by_entity(fill_across(panel, "entity", "period", "seg", ["v"], method, "row_id"))
    expected = {**ACROSS[method], "N5": [20.5, 41]}
    assert {e: pytest.approx(vs) for e, vs in expected.items()} == filled


def test_rows_without_a_key_are_ordered_by_their_content(spark):
    rows = [("E", "A", 1, None if i % 2 else float(i)) for i in range(40)]
    panel = spark.createDataFrame(rows, "entity string, seg string, period int, v double")

    def filled():
        df = fill_neighbours(panel, "entity", "period", "seg", {"v": NeighbourRule()})
        assert df.columns == panel.columns
        return sorted(r.v for r in df.collect())

    whole = filled()
    spark.conf.set("spark.panelweave.rowsPerChunk", "9")
    try:
        assert filled() == whole
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")


def test_mean_cascade(series, layout):
    panel = series({"E": [2.0, None, 4.0], "F": [None, None, None], "G": [8.0, 5.0, 1.0]})
    filled = by_entity(fill_mean_cascade(panel, "entity", "period", "seg", ["v"]))
    assert filled == {"E": [2, 3, 4], "F": [5, 5, 2.5], "G": [8, 5, 1]}


def test_median_cascade(series, layout):
    panel = series({"E": [2.0, None, 4.0, 9.0], "F": [None, None], "G": [8.0, 5.0, 1.0]})
    filled = fill_mean_cascade(panel, "entity", "period", "seg", ["v"], stat="median")
    assert by_entity(filled) == {"E": [2, 4, 4, 9], "F": [5, 5], "G": [8, 5, 1]}


def test_rules_are_checked(series):
    with pytest.raises(ValueError):
        NeighbourRule("nearest")
    with pytest.raises(ValueError):
        fill_previous_category(series({"E": [1.0]}), "entity", "period", "v", mode="next")
