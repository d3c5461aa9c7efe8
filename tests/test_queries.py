"""Every registered query against its SQL statement."""

import os

import compare
import pytest

from panelyard.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert compare.differences(df, duck, catalog.ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as driver
    rows = driver.entry(spark).collect()
    assert {r["model"] for r in rows} == {"equal_weight", "lowvol", "momentum", "reversal"}
    assert set(driver.oracle_sql()) <= set(driver.queries())
