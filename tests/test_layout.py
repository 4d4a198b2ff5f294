"""Panels stored by entity: the same rows, no exchange of them later, gone with their scope."""

import glob
import os
import re

import pytest

from panelweave import (
    describe_by_group,
    pareto_tiers,
    rolling_mean,
    scope,
    store_by_entity,
    trend_slope,
)
from panelweave.operators import rolling, summary, tiers
from panelweave.sources import pin_bucketed, workspace
from tests.test_plans import plan

ROWS = [(e, y, k, (e or 0) * 7 % 5 + y * 0.5) for k, (e, y) in enumerate((e, y) for e in [None, *range(9)] for y in range(4))]
SCHEMA = "entity long, period int, row_id long, `a value` double"


@pytest.fixture
def panel(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("a value", "v")


def questions(df):
    return {
        "describe": describe_by_group(df, "entity", "v"),
        "trend": trend_slope(df, "entity", "period", "v"),
        "rolling": rolling_mean(df, "entity", "period", "v", preceding=2, warmup=1, key="row_id"),
        "tiers": pareto_tiers(df, "entity", "v", (60, 90), period="period", key="row_id"),
    }


def exchanges_by_entity(df, name, monkeypatch):
    """Exchanges of rows by entity in every plan that reads the table ``name``, those of written steps included."""
    plans = []

    def pinned(step, label="t"):
        plans.append(plan(step, "simple"))
        return workspace.pin(step, label)

    for module in (summary, tiers, rolling):
        monkeypatch.setattr(module, "pin", pinned, raising=False)
    asked = questions(df)
    plans += [plan(answer, "simple") for answer in asked.values()]
    read = [text for text in plans if name in text]
    assert len(read) >= len(asked)
    return sum(len(re.findall(r"Exchange (?:hashpartitioning\(entity|rangepartitioning)", text)) for text in read)


def test_four_questions_on_a_stored_panel_exchange_no_rows(spark, panel, monkeypatch, tmp_path):
    stored = store_by_entity(panel, "entity", "period", "row_id")
    name = re.search(r"panelweave_panel_\w+", plan(stored, "simple"))[0]
    assert exchanges_by_entity(stored, name, monkeypatch) == 0
    # The same plans on rows without a layout, as a control.
    panel.write.parquet(str(tmp_path / "plain"))
    assert exchanges_by_entity(spark.read.parquet(str(tmp_path / "plain")), "plain", monkeypatch) >= 4


def test_joins_of_panels_stored_alike_exchange_nothing(spark, panel):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = store_by_entity(panel, "entity", "period", buckets=3), store_by_entity(panel, "entity", "period", buckets=3)
        joined = a.join(b.groupBy("entity").count(), "entity")
        assert "Exchange" not in plan(joined, "simple") and joined.count() == 36  # NULL joins nothing
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_answers_are_those_of_the_panel(layout, panel):
    stored = questions(store_by_entity(panel, "entity", "period", "row_id"))
    for name, answer in questions(panel).items():
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, answer.collect())), name


def test_rows_stay_with_null_entities_repeats_empty_tables_and_odd_names(spark, layout):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    twice = rows.union(rows)
    stored = store_by_entity(twice, "entity", "period")
    assert stored.columns == rows.columns
    assert sorted(map(str, stored.collect())) == sorted(map(str, twice.collect()))
    assert store_by_entity(rows.limit(0), "entity", "period", "row_id").collect() == []


def test_light_entities_make_one_file_a_bucket_and_heavy_ones_several(spark, panel):
    folder = os.path.dirname(store_by_entity(panel, "entity", "period", "row_id", buckets=2).inputFiles()[0])
    assert len(glob.glob(f"{folder.removeprefix('file:').replace('//', '/')}/*.parquet")) == 2
    one = panel.filter("entity = 1")
    spark.conf.set("spark.panelweave.rowsPerChunk", "2")
    try:
        assert len(store_by_entity(one, "entity", "period", "row_id", buckets=2).inputFiles()) > 1
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")


def test_a_scope_drops_the_table_and_its_files(spark, panel):
    kept = pin_bucketed(panel, ["entity"], buckets=2)
    before = {t.name for t in spark.catalog.listTables()}
    with scope(spark):
        inner = store_by_entity(panel, "entity", "period", "row_id")
        folder = os.path.dirname(inner.inputFiles()[0]).removeprefix("file:").replace("//", "/")
        assert os.path.exists(folder) and {t.name for t in spark.catalog.listTables()} - before
    assert not os.path.exists(folder) and {t.name for t in spark.catalog.listTables()} == before
    assert kept.count() == 40
