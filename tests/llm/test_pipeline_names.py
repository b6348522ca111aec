"""Column names of documents that operators use themselves, in every stage of the pipeline."""

import random

import pytest

import corpus_pipeline

CLASHING = (
    "_score score kept removed n_removed n_words _hash text_hash hits decoded ids n_tokens _row _node number key row "
    "fingerprint component_id first_of_group pieces spans _block none"
).split()


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    texts = {i: " ".join(f"w{rng.randrange(900)}" for _ in range(60)) for i in range(20)}
    texts |= {30: texts[3], 31: None, 32: "", 33: "nasty nasty nasty " * 20}
    rows = [(i, t, *(f"{name} {i}" for name in CLASHING)) for i, t in texts.items()]
    schema = "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in CLASHING)
    spark.createDataFrame(rows + rows[:2], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(33, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[5][:60])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_columns_keep_their_values(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        found = function(spark, docs, folder)
        kept = [c for c in docs.columns if name != "encoding" or c not in ("ids", "n_tokens", "round_trip")]
        assert found.columns[: len(kept)] == kept, name
        found.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        for row in docs.collect():
            for column in CLASHING:
                if column in kept:
                    assert row[column] == f"{column} {row['doc_id']}", (name, column)
    assert docs.filter("round_trip").count() == docs.count() > 10
    # Rows of one id and text are one document, and so are copies.
    assert docs.select("doc_id").distinct().count() == docs.count() and docs.filter("doc_id = 30").count() == 0
