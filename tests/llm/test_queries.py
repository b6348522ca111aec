"""Registered queries against their SQL, and the contract of all of them."""

import pytest

import __spark_entry__ as driver
import checks.compare
from gradeloom.llm.oracle import ORACLE
from gradeloom.llm.queries import QUERIES

COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "score": "double"},
}


@pytest.mark.parametrize("key", ORACLE)
def test_query_equals_sql(spark, sf_dir, key, monkeypatch):
    monkeypatch.setattr(checks.compare, "QUERIES", QUERIES)
    monkeypatch.setattr(checks.compare, "ORACLE", ORACLE)
    verdict, _ = checks.compare.compare(spark, sf_dir, key)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("key", COLUMNS)
def test_columns_and_rows(spark, sf_dir, key):
    found = QUERIES[key](spark, sf_dir)
    assert dict(found.dtypes).items() >= COLUMNS[key].items()
    table = "pages" if key.startswith("op3") else "documents"
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_all_are_registered():
    assert driver.queries().items() >= QUERIES.items() and "pipeline" in driver.queries()
    assert sorted(int(key[2:].split("_")[0]) for key in QUERIES) == list(range(1, 14))
