from conftest import by_entity

from panelweave import dedupe_keyed, replace_low_outliers, replace_out_of_range


def test_dedupe_keeps_smallest_key(spark):
    rows = [(2, "E", 2000), (1, "E", 2000), (3, "E", 2001), (5, None, 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, entity string, period int")
    once = dedupe_keyed(df, ["entity", "period"], "row_id")
    assert sorted(r.row_id for r in once.collect()) == [1, 3, 4]
    assert sorted(dedupe_keyed(once, ["entity", "period"], "row_id").collect()) == sorted(once.collect())


def test_low_outliers(series, layout):
    panel = series({"E": [9.0, 9.0, 9.0, 1.0], "F": [1.0, 5.0], "G": [None, 30.0, 0.0, 0.7]})
    low = by_entity(replace_low_outliers(panel, "entity", {"v": 1}))
    # F's 1 equals a third of its mean and stays.
    assert low == {"E": [9, 9, 9, 7], "F": [1, 5], "G": [None, 30, 10.2, 10.2]}


def test_comparison_with_a_third_of_the_mean_is_strict_and_exact(series, layout):
    # As doubles, 2.1 / 3 is above 0.7, and 0.1 + 0.3 + 0.5 depends on the order.
    panel = series({"E": [0.7, 3.5], "F": [0.1, 0.3, 0.5], "G": [0.1, 0.30000000000000004, 0.5], "H": [0.6999999999999999, 3.5]})
    got = by_entity(replace_low_outliers(panel, "entity", {"v": 2}))
    assert got["E"][0] == 0.7 and got["F"][0] == 0.1
    assert got["G"][0] == 0.3 and got["H"][0] == 2.1


def test_out_of_range(series, layout):
    panel = series({"E": [15.0, 40.0, 14.99, 40.01, None], "F": [50.0, 60.0]})
    assert by_entity(replace_out_of_range(panel, "entity", {"v": (15, 40)})) == {
        "E": [15, 40, 27.5, 27.5, None],
        "F": [50, 60],
    }
