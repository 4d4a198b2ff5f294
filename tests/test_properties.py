"""What must hold for any panel, on random ones, against plain Python where that is short."""

import random
import statistics

import pytest
from conftest import by_entity
from pyspark.sql import functions as F

from panelweave import (
    NeighbourRule,
    dedupe_keyed,
    describe_by_group,
    fill_mean_cascade,
    fill_neighbours,
    pareto_tiers,
    pearson,
    rolling_mean,
    trend_slope,
)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    return [
        (
            i,
            f"e{rng.randrange(12)}",
            rng.randrange(2000, 2030),
            rng.choice(["s", "t", None]),
            None if rng.random() < 0.35 else round(rng.uniform(1, 90), 2),
            None if rng.random() < 0.2 else float(rng.randrange(9)),
        )
        for i in range(n)
    ]


COLUMNS = "row_id long, entity string, period int, seg string, v double, w double"


@pytest.fixture(params=[1, 2])
def rows(request):
    return random_rows(request.param)


@pytest.fixture
def panel(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("edge", ["first_value", "lead_then_last", "adjacent"])
def test_fills_keep_rows_and_known_values(panel, rows, edge):
    filled = fill_neighbours(
        panel, "entity", "period", "seg", {"v": NeighbourRule(edge)}, "row_id"
    )
    filled = fill_mean_cascade(filled, "entity", "period", "seg", ["w"]).collect()
    assert len(filled) == len(rows)
    got = {r.row_id: (r.v, r.w) for r in filled}
    for row_id, _, _, _, v, w in rows:
        assert v is None or got[row_id][0] == v
        assert w is None or got[row_id][1] == w


def test_adjacent_fill_by_hand(panel, rows):
    got = by_entity(
        fill_neighbours(panel, "entity", "period", "seg", {"v": NeighbourRule()}, "row_id")
    )
    cells = {}
    for _, _, period, seg, v, _ in rows:
        if v is not None:
            cells.setdefault((seg, period), []).append(v)
    for entity, filled in got.items():
        series = sorted((r for r in rows if r[1] == entity), key=lambda r: (r[2], r[0]))
        for i, (_, _, period, seg, v, _) in enumerate(series):
            lag = series[i - 1][4] if i else None
            lead = series[i + 1][4] if i + 1 < len(series) else None
            known = [x for x in (lag, lead) if x is not None]
            pool = known or cells.get((seg, period))
            expected = v if v is not None else statistics.fmean(pool) if pool else None
            assert filled[i] == (None if expected is None else pytest.approx(expected))


def test_rolling_by_hand(panel, rows):
    got = by_entity(rolling_mean(panel, "entity", "period", "v", key="row_id"), "moving_avg")
    for entity, means in got.items():
        series = sorted((r for r in rows if r[1] == entity), key=lambda r: (r[2], r[0]))
        for i, mean in enumerate(means):
            frame = [r[4] for r in series[max(0, i - 5) : i + 1] if r[4] is not None]
            if series[i][2] < series[0][2] + 4:
                assert mean == 0
            elif frame:
                assert mean == pytest.approx(statistics.fmean(frame))
            else:
                assert mean is None


def test_medians_by_hand(panel, rows):
    for row in describe_by_group(panel, "entity", "v").collect():
        values = [r[4] for r in rows if r[1] == row.entity and r[4] is not None]
        assert row["median"] == pytest.approx(statistics.median(values), abs=0.00501)
        assert (row.minimum, row.maximum) == (min(values), max(values))


def test_slopes_by_hand(panel, rows):
    known = [r for r in rows if r[4] is not None]  # without gaps both formulas agree
    df = panel.filter("v IS NOT NULL")
    for row in trend_slope(df, "entity", "period", "v").collect():
        series = [r for r in known if r[1] == row.entity]
        x = [1 + sum(o[2] < r[2] for o in series) for r in series]
        mean = statistics.fmean(r[4] for r in series)
        fit = statistics.linear_regression(x, [r[4] / mean for r in series])
        assert row.slope == pytest.approx(fit.slope)
    r = pearson(df, [("v", "period")]).first()[0]
    assert -1 <= r <= 1
    assert r == pytest.approx(statistics.correlation([k[4] for k in known], [k[2] for k in known]))


def test_dedupe_is_idempotent(panel, rows):
    once = dedupe_keyed(panel, ["entity", "period"], "row_id")
    assert {(r.entity, r.period) for r in once.collect()} == {(r[1], r[2]) for r in rows}
    assert sorted(dedupe_keyed(once, ["entity", "period"], "row_id").collect()) == sorted(once.collect())


def test_tiers_cover_every_entity_once(panel, rows):
    tiers = pareto_tiers(panel, "entity", "v", (40, 80), "mean", digits=4).collect()
    assert sorted(t.entity for t in tiers) == sorted({r[1] for r in rows})
    assert sorted(t.counting for t in tiers) == list(range(1, len(tiers) + 1))
    assert sum(t.percent_in_total for t in tiers) == max(t.rolling_percent for t in tiers)
    place = {"high": 0, "medium": 1, "low": 2}
    ordered = sorted(tiers, key=lambda t: t.counting)
    assert [place[t.tier] for t in ordered] == sorted(place[t.tier] for t in tiers)


def test_input_order_and_partitions_do_not_matter(spark, rows):
    def result(shuffled, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        panel = spark.createDataFrame(shuffled, COLUMNS).repartition(int(partitions))
        rule = {"v": NeighbourRule("lead_then_last", 2)}
        filled = fill_neighbours(panel, "entity", "period", "seg", rule, "row_id")
        single = dedupe_keyed(filled, ["entity", "period"], "row_id")
        trend = trend_slope(single, "entity", "period", "v")
        return [
            sorted(tuple(r) for r in single.select("row_id", F.coalesce("v", F.lit(-1.0))).collect()),
            sorted((r.entity, round(r.slope, 9), r.trend) for r in trend.collect()),
        ]

    mixed = random.Random(3).sample(rows, len(rows))
    try:
        assert result(rows, "4") == result(mixed, "7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
