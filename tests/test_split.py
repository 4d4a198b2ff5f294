"""Splitting heavy entities must not change any result."""

import random

import pytest
from pyspark.sql import functions as F

from panelweave import (
    NeighbourRule,
    describe_by_group,
    fill_mean_cascade,
    fill_neighbours,
    fill_previous_category,
    pareto_tiers,
    replace_low_outliers,
    replace_out_of_range,
    rolling_mean,
    running_totals,
    trend_slope,
)
from panelweave.operators.spread import CHUNK, rows_per_chunk, split_heavy
from panelweave.plans import clean
from panelweave.plans.clean import CleaningSpec, Ratio, clean_panel
from panelweave.sources import pin


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """One entity holds a third of all rows, another is NULL; periods repeat; many gaps."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        entity = "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"e{rng.randrange(40)}"
        period = rng.choice([5, 5, 5, rng.randrange(30)])
        value = None if rng.random() < 0.4 else float(rng.randrange(60))
        other = None if rng.random() < 0.3 else float(rng.randrange(5))
        status = rng.choice(["a", "b", None])
        rows.append((i, entity, period, rng.choice(["s", "t", None]), status, value, other))
    df = spark.createDataFrame(
        rows,
        "row_id long, entity string, period int, seg string, status string, v double, w double",
    )
    path = str(tmp_path_factory.mktemp("panel") / "p")
    df.write.parquet(path)
    return spark.read.parquet(path)


SPEC = CleaningSpec(
    key="row_id",
    entity="entity",
    period="period",
    group="status",
    previous_category="status",
    neighbour_fills={"v": NeighbourRule("first_value")},
    mean_fills=("w",),
    low_outliers={"v": 2},
    ranges={"w": (1, 3)},
    ratio=Ratio("w", "v", "ratio"),
)

OPERATORS = {
    **{
        edge: lambda df, edge=edge: fill_neighbours(
            df, "entity", "period", "seg", {"v": NeighbourRule(edge), "w": NeighbourRule(edge, 1)}, "row_id"
        )
        for edge in ("first_value", "lead_then_last", "adjacent")
    },
    "lag1": lambda df: fill_previous_category(df, "entity", "period", "status", "row_id"),
    "last_seen": lambda df: fill_previous_category(
        df, "entity", "period", "status", "row_id", mode="last_seen"
    ),
    "cascade": lambda df: fill_mean_cascade(df, "entity", "period", "seg", ["v", "w"]),
    "low": lambda df: replace_low_outliers(df, "entity", {"v": 2, "w": 0}),
    "range": lambda df: replace_out_of_range(df, "entity", {"v": (15, 40)}),
    "rolling": lambda df: rolling_mean(df, "entity", "period", "v", key="row_id"),
    "describe": lambda df: describe_by_group(df, "entity", "v"),
    "ranked": lambda df: describe_by_group(df, "entity", "v", nulls="first"),
    "trend": lambda df: trend_slope(df, "entity", "period", "v"),
    "pairwise": lambda df: trend_slope(df, "entity", "period", "v", pairwise=True),
    "tiers": lambda df: pareto_tiers(df, "entity", "v", (50, 80), "latest", "period", "row_id"),
    "total": lambda df: running_totals(df, ["entity"], ["-period", "row_id"], {"t": F.col("w")}).drop(CHUNK),
    "clean": lambda df: clean_panel(df, SPEC),
}


def rows(df):
    def cell(v):
        return (v is not None, round(v, 7) if isinstance(v, float) else v)

    return sorted((tuple(cell(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_split_changes_nothing(spark, panel, name):
    whole = OPERATORS[name](panel)
    expected = rows(whole)
    spark.conf.set("spark.panelweave.rowsPerChunk", "25")
    try:
        split = OPERATORS[name](panel)
        assert split.columns == whole.columns
        assert rows(split) == expected
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")


def test_chunks_are_bounded_ordered_and_complete(spark, panel):
    spark.conf.set("spark.panelweave.rowsPerChunk", "25")
    try:
        split = split_heavy(panel, ["entity"], ["period", "row_id"])
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")
    assert split.drop(CHUNK).exceptAll(panel).isEmpty() and split.count() == panel.count()
    hot = split.filter(f"{CHUNK} > 0")
    assert {r.entity for r in hot.select("entity").distinct().collect()} == {"hot", None}
    sizes = [r["count"] for r in hot.groupBy("entity", CHUNK).count().collect()]
    assert len(sizes) > 6 and max(sizes) <= 75
    ends = (
        hot.filter("entity = 'hot'")
        .groupBy(CHUNK)
        .agg(F.min(F.struct("period", "row_id")), F.max(F.struct("period", "row_id")))
        .orderBy(CHUNK)
        .collect()
    )
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_limit_does_not_grow_with_the_rows_or_partitions(spark):
    assert rows_per_chunk(spark) == 2_000_000
    spark.conf.set("spark.panelweave.rowsPerChunk", "10")
    try:
        assert rows_per_chunk(spark) == 10
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")


def test_even_panels_are_left_alone(panel):
    assert split_heavy(panel, ["entity"], ["period"]) is panel


def test_cleaning_writes_only_heavy_rows_between_steps(spark, panel, monkeypatch):
    written = []

    def recorded(df, label="t"):
        table = pin(df, label)
        written.append((label, table))
        return table

    monkeypatch.setattr(clean, "pin", recorded)
    spark.conf.set("spark.panelweave.rowsPerChunk", "150")
    try:
        cleaned = clean_panel(panel, SPEC)
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")
    assert [label for label, _ in written] == ["step"] * 4
    for _, table in written:
        assert {r.entity for r in table.select("entity").distinct().collect()} == {"hot"}
    # Rows of ordinary entities: one shuffle by entity, below one sort, for all windows.
    cold = cleaned._jdf.queryExecution().executedPlan().toString().split("\n")
    union = next(i for i, line in enumerate(cold) if "Union" in line)
    depth = cold[union].index("Union")
    second = [i for i, line in enumerate(cold) if i > union and line[depth : depth + 2] == "+-"][0]
    branch = "\n".join(cold[union:second])
    assert branch.count("- Exchange hashpartitioning") == 1 and branch.count("Sort [") == 1


@pytest.mark.parametrize("limit", ["25", "2000000"])
def test_whole_entity_values_scan_twice(spark, panel, limit):
    spark.conf.set("spark.panelweave.rowsPerChunk", limit)
    try:
        repaired = replace_low_outliers(panel, "entity", {"v": 2})
    finally:
        spark.conf.unset("spark.panelweave.rowsPerChunk")
    # The first scan wrote the totals; this is the second one, joined with them.
    files = repaired.inputFiles()
    assert sum("panelweave" not in f for f in files) == len(panel.inputFiles())
    plan = repaired._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Window" not in plan
