"""From raw documents to encoded training text: five stages, each written before the next.

A stage works on the id, the text and one struct of all other columns, so that no column of the
documents can have the name of one that an operator adds.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.llm.byte_bpe import encode
from gradeloom.llm.decontamination import find_benchmark_passages, without_passages
from gradeloom.llm.simhash import near_duplicate_groups
from gradeloom.llm.substring_dedup import remove_repeated_passages
from gradeloom.llm.toxicity import class_prior, score_toxicity, train_toxicity
from gradeloom.staging import stage

# Scores from here on are toxic.
TOXIC = 0.3
# Near duplicates differ in at most so many bits of the fingerprints of their three-word shingles.
SHINGLE, MAX_BITS = 3, 3


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns as ``row``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))


def _unpacked(found: DataFrame, docs: DataFrame, changed: bool = False) -> list[Column]:
    """The columns of ``docs``; the number of characters is counted again if texts have ``changed``."""
    columns = []
    for name in docs.columns:
        if name in ("doc_id", "text"):
            columns.append(F.col(name))
        elif name == "n_chars" and changed:
            columns.append(F.length("text").cast("long").alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return columns


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below ``TOXIC``; the classifier learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = train_toxicity(docs, labels.filter("toxic = 1"), class_prior(labels))
    scored = score_toxicity(_packed(docs), model).filter(F.col("score") < TOXIC)
    return scored.select(_unpacked(scored, docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the least id."""
    parts = (F.coalesce(part, F.lit("none")) for part in (F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))
    key = F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))
    rows = _packed(docs).withColumn("key", key)
    groups = near_duplicate_groups(rows, shingle=SHINGLE, max_bits=MAX_BITS, keep=["doc_id", "key"])
    firsts = stage(groups.filter("first_of_group").select("key"), "firsts")
    # Rows meet by id and text, so that a large group is no hot key; a merge join at every size.
    kept = rows.join(firsts.hint("merge"), "key", "left_semi")
    # Rows of one id and text are one document.
    kept = kept.dropDuplicates(["key"])
    return kept.select(_unpacked(kept, docs))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; those that lose none keep their text as it is."""
    found = remove_repeated_passages(_packed(docs))
    found = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return found.select(_unpacked(found, docs, changed=True))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    found = find_benchmark_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = stage(found.filter("n_hit > 0").select("doc_id", "text_hash", "hits").distinct(), "hits")
    rows = _packed(docs).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash"))
    joined = rows.alias("d").join(hits.alias("h"), same, "left").select("d.doc_id", "d.text", "d.row", "h.hits")
    cut = without_passages(joined)
    return cut.select(_unpacked(cut, docs, changed=True))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; ``round_trip`` is whether they decode to it."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(_packed(docs), ranks, public_tokenizers.PATTERN, decoded="decoded")
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    added = {"ids": F.col("ids"), "n_tokens": F.size("ids").cast("long"), "round_trip": whole}
    kept = [column for name, column in zip(docs.columns, _unpacked(found, docs)) if name not in added]
    return found.select(*kept, *(column.alias(name) for name, column in added.items()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("encoding", encoded),
]

# A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
