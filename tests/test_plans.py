"""What the physical plans look like, since results alone do not show scale."""

import io
import re
from contextlib import redirect_stdout

import pytest

from panelweave import dedupe_keyed, pearson, rows_at_extremes
from panelweave.plans import health
from panelweave.plans.catalog import orders_by_year
from panelweave.plans.samples import customer_year, health_staging, table, user_day

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "p")
    health_staging(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


def test_cleaning_shuffles_rows_once(raw):
    text = plan(health.clean_health_panel(raw))
    tree = text.split("\n\n")[0]
    # The group means are broadcast from written tables; all windows share the entity's shuffle.
    assert len(re.findall(r"[+:]- (?:Exchange|ReusedExchange)", tree)) == 1
    assert "SortMergeJoin" not in tree and tree.count("Sort (") == 1
    assert "SinglePartition" not in text


def test_cleaning_has_no_cross_join_or_python(raw):
    text = plan(health.clean_health_panel(raw))
    for node in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "Arrow"):
        assert node not in text


def test_dedupe_prunes_before_the_shuffle(spark):
    text = plan(dedupe_keyed(orders_by_year(spark, FOLDER), ["entity", "period"], "row_id"), "simple")
    exchange = text.index("Exchange hashpartitioning")
    assert text.index("WindowGroupLimit", exchange) > exchange  # below the exchange in the tree


def test_correlation_reads_two_columns_once(spark):
    text = plan(pearson(table(spark, FOLDER, "lineitem"), [("l_quantity", "l_discount")]))
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in text
    assert len(re.findall(r"\(\d+\) Scan parquet", text)) == 1


def test_extremes_use_one_aggregate(spark):
    lines = table(spark, FOLDER, "lineitem")
    result = rows_at_extremes(lines, "l_quantity", ["l_orderkey", "l_quantity"])
    text = plan(result)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "l_comment" not in text and "l_shipdate" not in text


def test_entities_by_period_are_not_broadcast(spark):
    """Their number is far above what the size of the entities' file tells the planner."""
    for rows in (customer_year(spark, FOLDER), user_day(spark, FOLDER)):
        for asked in (rows, rows.filter("m1 IS NOT NULL")):
            text = plan(asked, "simple")
            assert "SortMergeJoin [entity" in text and "BroadcastExchange" not in text
    text = plan(health_staging(spark, FOLDER), "simple")
    assert "SortMergeJoin [country" in text and "BroadcastHashJoin [country" not in text
