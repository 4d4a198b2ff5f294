"""Clean a raw health panel, store it, and store the answer to every question.

``spark-submit panelweave/plans/report.py RAW OUT [csv|parquet|orc] [REGIONS]``

``REGIONS`` is a parquet table with the columns ``Country`` and ``region``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from panelweave.operators import store_by_entity
from panelweave.plans import health
from panelweave.sources import read_raw, release, scope, write_panel


def write_report(
    spark: SparkSession, raw: DataFrame, out: str, regions: DataFrame | None = None
) -> list[str]:
    """Write the raw table, the audits, the cleaned panel and all answers below ``out``.

    The raw table is stored first: the audits and the cleaning read it several times, but not all
    of its columns. Returns the names of what was written.
    """
    write_panel(raw, f"{out}/staging")
    raw = spark.read.schema(raw.schema).parquet(f"{out}/staging")
    write_panel(health.audit_health_panel(raw), f"{out}/audit")
    write_panel(health.cast_losses(raw), f"{out}/cast_losses")
    write_panel(health.missing_gdp(raw), f"{out}/missing_gdp")
    with scope(spark):
        write_panel(health.clean_health_panel(raw), f"{out}/panel")
    panel = spark.read.parquet(f"{out}/panel")
    questions = dict(health.QUESTIONS)
    if regions is not None:
        questions["life_expectancy_by_region"] = lambda panel: health.life_expectancy_by_region(
            panel, regions
        )
    with scope(spark):
        # All questions read one copy of the panel that needs no shuffle by entity.
        panel = store_by_entity(panel, health.ENTITY, health.PERIOD, health.KEY)
        for name, ask in questions.items():
            with scope(spark):
                write_panel(ask(panel), f"{out}/{name}")
    return ["staging", "audit", "cast_losses", "missing_gdp", "panel", *questions]


def main(raw: str, out: str, fmt: str = "csv", regions: str | None = None) -> None:
    spark = SparkSession.builder.appName("health-report").getOrCreate()
    table = read_raw(spark, raw, health.RAW_COLUMNS, fmt)
    write_report(spark, table, out, spark.read.parquet(regions) if regions else None)
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
