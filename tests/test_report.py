"""From a raw csv file to stored answers."""

import pytest
from pyspark.sql import functions as F

from panelweave import read_raw
from panelweave.plans import health
from panelweave.plans.report import write_report
from panelweave.plans.samples import health_staging, regions

FOLDER = "/root/testdata/sf0.001"


def test_report_from_csv(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    health_staging(spark, FOLDER).select(*health.RAW_COLUMNS).write.csv(raw, header=True)
    places = regions(spark, FOLDER, "key").select(F.col("key").cast("string").alias("Country"), "region")
    names = write_report(spark, read_raw(spark, raw, health.RAW_COLUMNS), out, places)
    assert len(names) == 5 + len(health.QUESTIONS) + 1
    read = {n: spark.read.parquet(f"{out}/{n}") for n in names}
    panel = read["panel"]
    assert set(read["cast_losses"].first()) == {0}
    assert panel.count() == 150 * 7 == panel.select("Country", "Year").distinct().count()
    assert panel.schema["Lifeexpectancy"].dataType.simpleString() == "decimal(4,2)"
    # The fills leave no gap except where the first or last year of a series is one.
    left = {c for c, n in health.audit_health_panel(health_staging(spark, FOLDER)).first().asDict().items() if n}
    still = {c for c in panel.columns if panel.filter(F.col(c).isNull()).count()}
    assert "GDP" in left and "GDP" not in still and "Measles" not in still
    # Outlier rules hold on the result.
    assert panel.filter("BMI NOT BETWEEN 15 AND 40").join(
        panel.filter("BMI BETWEEN 15 AND 40"), "Country", "left_semi"
    ).isEmpty()
    assert read["life_expectancy_by_region"].count() == 5
    corr = read["mortality_correlation"].first()[0]
    assert -1 <= corr <= 1


def test_lines_of_another_length_and_lost_values_are_not_silent(spark, tmp_path):
    for name, line in (("more", "3,4,5"), ("fewer", "6")):
        (tmp_path / f"{name}.csv").write_text(f"a,b\n1,2\n{line}\n")
        with pytest.raises(Exception, match="(?i)malformed"):
            read_raw(spark, str(tmp_path / f"{name}.csv"), ["a", "b"]).select("a").collect()
    raw = health_staging(spark, FOLDER)
    first = raw.agg(F.min("Row_ID")).first()[0]
    raw = raw.withColumn("BMI", F.when(F.col("Row_ID") == first, "12x").otherwise(F.col("BMI")))
    assert health.cast_losses(raw).first().BMI == 1
