"""Runs on disk: weights, scores with labels, and a manifest that is written last.

Every attempt to store a run writes into folders of its own.  A run exists from the moment its
line of the manifest does, so what a broken attempt left behind is never read, and a
run that is stored again takes the place of the earlier one in a single step.

    <path>/scores/attempt=<id>     row_idx, label, logits, split
    <path>/weights/attempt=<id>    feature, n, weight
    <path>/manifest                one file per commit
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MANIFEST = (
    "run_id string, attempt string, sequence bigint, settings map<string, string>, metrics map<string, double>, "
    "min_f1 double, splits array<string>, has_weights boolean"
)
SCORES = "row_idx bigint, label int, logits array<double>, split string, attempt string"
WEIGHTS = "feature string, n bigint, weight double, attempt string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """All commits; none if nothing was ever committed."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The last commit of every run, a line each."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("sequence"), F.desc("attempt"))
    return _manifest(spark, path).withColumn("place", F.row_number().over(latest)).filter("place = 1").drop("place")


def _stored(label: Column | None, scored: DataFrame, split: str) -> DataFrame:
    label = F.lit(None) if label is None else label
    return scored.select(
        F.col("row_idx").cast("long").alias("row_idx"),
        label.cast("int").alias("label"),
        F.col("logits").cast("array<double>").alias("logits"),
        F.lit(split).alias("split"),
    )


def commit_run(
    path: str,
    run_id: str,
    scores: Mapping[str, DataFrame],
    metrics: Mapping[str, float],
    settings: Mapping[str, object],
    weights: DataFrame | None = None,
    min_f1: float | None = None,
) -> str:
    """Write a run and then commit it; returns the id of the attempt.

    ``scores`` has a table with ``row_idx``, ``logits`` and maybe a ``label`` for every split.  One
    driver writes to a store at a time; readers may read meanwhile.
    """
    if not scores:
        raise ValueError("a run has the scores of one split at least")
    spark = next(iter(scores.values())).sparkSession
    attempt = uuid.uuid4().hex
    for split, scored in scores.items():
        label = F.col("label") if "label" in scored.columns else None
        _stored(label, scored, split).write.mode("append").parquet(f"{path}/scores/attempt={attempt}")
    if weights is not None:
        weights.select("feature", F.col("n").cast("long").alias("n"), "weight").write.parquet(f"{path}/weights/attempt={attempt}")
    sequence = (_manifest(spark, path).agg(F.max("sequence")).first()[0] or 0) + 1
    said = {name: str(value) for name, value in settings.items()}
    measured = {name: float(value) for name, value in metrics.items()}
    line = (run_id, attempt, sequence, said, measured, min_f1, list(scores), weights is not None)
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return attempt


def read_run_scores(spark: SparkSession, path: str, run_id: str | None = None, split: str | None = None) -> DataFrame:
    """``run_id``, ``split``, ``row_idx``, ``label`` and ``logits`` of committed runs; only their folders are read."""
    runs = read_runs(spark, path).select("run_id", "attempt")
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    # One line per run, as many as the driver has committed.
    committed = [row["attempt"] for row in runs.collect()]
    if not committed:
        return spark.createDataFrame([], SCORES).select(F.lit("").alias("run_id"), "split", "row_idx", "label", "logits")
    stored = spark.read.schema(SCORES).parquet(f"{path}/scores").filter(F.col("attempt").isin(committed))
    if split is not None:
        stored = stored.filter(F.col("split") == split)
    return stored.join(F.broadcast(runs), "attempt").select("run_id", "split", "row_idx", "label", "logits")


def read_weights(spark: SparkSession, path: str, attempt: str) -> DataFrame:
    """The weights of one attempt."""
    stored = spark.read.schema(WEIGHTS).parquet(f"{path}/weights")
    return stored.filter(F.col("attempt") == attempt).drop("attempt")
