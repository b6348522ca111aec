"""Stand-ins for the inputs, derived from the test tables.

The same tables are written in SQL in ``checks.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.functions.labels import binarize

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "par_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "par_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, graded 0 to 4."""
    grade = (
        F.when(F.col("toxic") == 1, 4 - F.col("quality"))
        .when(F.col("quality") == 0, 2)
        .otherwise((F.col("par_id") % 13 >= 6).cast("int"))
    )
    return (
        _labels(spark, sf_dir)
        .join(documents(spark, sf_dir), "par_id")
        .select(
            "par_id",
            F.concat(F.lit("a"), F.col("par_id").cast("string")).alias("art_id"),
            F.col("source").alias("keyword"),
            F.col("lang").alias("country_code"),
            "text",
            grade.cast("int").alias("label"),
        )
    )


def all_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split list of all documents; most have no corpus row."""
    return documents(spark, sf_dir).select("par_id", F.col("source").alias("label"))


def gold_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split list of all labelled documents."""
    return _labels(spark, sf_dir).select("par_id", F.col("quality").cast("string").alias("label"))


def train_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents; some have no corpus row."""
    english = documents(spark, sf_dir).filter(F.col("lang") == "en")
    return english.select("par_id", F.col("source").alias("label"))


def dev_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the other languages."""
    foreign = documents(spark, sf_dir).filter(F.col("lang") != "en").select("par_id")
    return gold_list(spark, sf_dir).join(foreign, "par_id")


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed copy of every English positive; copies keep the id."""
    positives = corpus(spark, sf_dir).filter((F.col("label") > 1) & (F.col("country_code") == "en"))
    return positives.select(
        "par_id",
        F.col("keyword").alias("label"),
        F.concat(F.lit("bt "), "text").alias("text"),
        F.lit("bt").alias("copy_no"),
    )


def prediction() -> Column:
    """Right for most rows, wrong for two of nine ids, so that all four counts fill up."""
    return ((F.col("label") > 1) == (F.col("par_id") % 9 >= 2)).cast("int")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled documents with both label forms and a prediction."""
    return (
        corpus(spark, sf_dir)
        .withColumn("prediction", prediction().cast("string"))
        .withColumn("graded", F.col("label"))
        .withColumn("label", binarize(F.col("label")))
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training log per vector, one entry per element."""
    entry = lambda x, i: F.struct(
        (i + 1).cast("double").alias("epoch"),
        x.cast("double").alias("eval_accuracy"),
        F.abs(x.cast("double")).alias("eval_f1"),
    )
    vectors = load(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("run_id"), F.transform("embedding", entry).alias("log_history"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores and a binary label per vector: the largest of every other element, from the first and the second on."""
    def largest(first: int) -> Column:
        return F.array_max(F.filter("embedding", lambda _, i: i % 2 == first)).cast("double")

    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_idx"),
        F.array(largest(0), largest(1)).alias("logits"),
        (F.col("label") > 4).cast("int").alias("label"),
        F.lit("run-1").alias("run_id"),
        F.when(F.col("label") < 5, "valid").otherwise("final").alias("split"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per vector with its largest entry as F1."""
    f1 = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("run-"), F.col("vec_id").cast("string")).alias("run_id"),
        F.when(F.col("label") < 5, "valid").otherwise("dev").alias("split"),
        f1.alias("f1"),
    )


def one_line(text: str) -> Column:
    """A text without line breaks and tabs, for files of one row per line."""
    return reduce(lambda kept, mark: F.replace(kept, F.lit(mark), F.lit(" ")), "\n\r\t", F.col(text))


def rounded(query: Query) -> Query:
    """Round the metrics of a result, so that engines can be compared."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = query(spark, sf_dir)
        doubles = [name for name, kind in result.dtypes if kind == "double"]
        return result.withColumns({name: F.round(name, 6) for name in doubles})

    return run
