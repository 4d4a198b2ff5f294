import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "1000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def layout(request, spark):
    """Runs a test twice: entities kept whole, and entities of more than two rows split."""
    if request.param == "split":
        spark.conf.set("spark.panelweave.rowsPerChunk", "2")
    yield request.param
    spark.conf.unset("spark.panelweave.rowsPerChunk")


@pytest.fixture
def series(spark):
    """Builds a panel (row_id, entity, seg, period, v) from {entity: values}, periods from 1."""

    def build(values, seg=None, start=1, dtype="double"):
        rows, i = [], 0
        for entity, vs in values.items():
            for period, v in enumerate(vs, start):
                i += 1
                rows.append((i, entity, (seg or {}).get(entity, "A"), period, v))
        return spark.createDataFrame(
            rows, f"row_id long, entity string, seg string, period int, v {dtype}"
        )

    return build


def by_entity(df, column="v"):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (str(r["entity"]), r["period"], r["row_id"])):
        out.setdefault(row["entity"], []).append(row[column])
    return out
