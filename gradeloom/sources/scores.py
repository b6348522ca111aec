"""Stored scores and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.arrays import every_nth

SCORES = "row_idx bigint, logits array<double>, run_id string, split string"
LOG = "run_id bigint, log_history array<struct<epoch: double, eval_accuracy: double, eval_f1: double>>"


def write_scores(df: DataFrame, path: str) -> None:
    """Scores of runs and their splits; a read of one run or split sees only its files.

    A run and split that was written before is replaced, all others stay.
    """
    rows = df.select(
        F.col("row_idx").cast("long").alias("row_idx"),
        F.col("logits").cast("array<double>").alias("logits"),
        F.col("run_id").cast("string").alias("run_id"),
        "split",
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "split").parquet(path)


def read_scores(spark: SparkSession, path: str, run_id: str | None = None, split: str | None = None) -> DataFrame:
    scores = spark.read.schema(SCORES).parquet(path)
    for column, wanted in (("run_id", run_id), ("split", split)):
        if wanted is not None:
            scores = scores.filter(F.col(column) == wanted)
    return scores


def read_training_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Training logs, one JSON object each, with the entries as an array.

    ``multi_line=False`` reads files of one log per line, which Spark can split.
    ``file`` tells logs without a run id apart.
    """
    logs = spark.read.schema(LOG).option("multiLine", multi_line).json(path)
    return logs.withColumn("file", F.col("_metadata.file_name"))


def log_entries(logs: DataFrame, *keep: str) -> DataFrame:
    """One row per log entry with its position."""
    entries = logs.select(*keep, F.posexplode("log_history").alias("pos", "entry"))
    return entries.select(*keep, "pos", "entry.*")


def log_series(logs: DataFrame, *keep: str, start: int = 1, step: int = 3) -> DataFrame:
    """Epoch, accuracy and F1 of the evaluation entries in log order."""
    evaluations = logs.select(*keep, F.posexplode(every_nth(F.col("log_history"), start, step)).alias("pos", "entry"))
    return evaluations.select(*keep, "pos", "entry.epoch", "entry.eval_accuracy", "entry.eval_f1")
