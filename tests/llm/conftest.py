import pytest


@pytest.fixture
def table(spark):
    """A frame of documents in several partitions."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
