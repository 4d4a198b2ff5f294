"""Every query of the panel library against its SQL, on the smallest tables."""

import functools

import pytest

import __spark_entry__ as driver
from oracle import ORACLE
from panelweave.plans import catalog
from tools.check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module", autouse=True)
def clean_once():
    """The questions share one cleaned panel here; the cleaning has a query of its own."""
    original = catalog.clean_snapshot
    catalog.clean_snapshot = functools.cache(original)
    yield
    catalog.clean_snapshot = original


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(ORACLE)
    assert catalog.QUERIES.items() <= driver.queries().items()
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["tier", "avg_m1"] and result.count() == 3
