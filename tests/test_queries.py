"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from checks.compare import compare
from checks.oracle import ORACLE
from checks.queries import QUERIES

@pytest.mark.parametrize("key", [key for key in QUERIES if key in ORACLE])
def test_query_equals_sql(spark, sf_dir, key):
    verdict, _ = compare(spark, sf_dir, key)
    assert verdict.startswith("ok"), verdict


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


def test_driver_entry(spark):
    flagship = driver.entry(spark)
    assert flagship.columns == ["keyword", "n", "tp", "tn", "fn", "fp", "recall", "precision", "f1_score", "accuracy"]
    assert flagship.count() > 0
    assert driver.queries().items() >= QUERIES.items()
    assert driver.oracle_sql().items() >= ORACLE.items()
    assert driver.oracle_sql().keys() <= driver.queries().keys()
