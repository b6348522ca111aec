"""From stored scores to ordered label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.arrays import argmax
from gradeloom.sources.lines import write_label_lines
from gradeloom.sources.run_store import read_run_scores
from gradeloom.sources.scores import read_scores

SPLITS = ("valid", "final")


def _require_positions(labels: DataFrame, what: str) -> None:
    """Fail if a position occurs more than once or is missing."""
    n, different, known = labels.agg(F.count("*"), F.count_distinct("row_idx"), F.count("row_idx")).first()
    if not n == different == known:
        raise ValueError(f"{what}: {n} scores for {different} positions")


def write_label_files(
    spark: SparkSession, scores_path: str, run_id: str, output: str, single_file: bool = False
) -> dict[str, str]:
    """Write the predicted classes of a run, one folder per split; returns the folders."""
    return {split: _written(read_scores(spark, scores_path, run_id, split), run_id, split, output, single_file) for split in SPLITS}


def write_run_labels(spark: SparkSession, store: str, run_id: str, output: str, single_file: bool = False) -> dict[str, str]:
    """The same for a run that was committed to a run store."""
    return {split: _written(read_run_scores(spark, store, run_id, split), run_id, split, output, single_file) for split in SPLITS}


def _written(scores: DataFrame, run_id: str, split: str, output: str, single_file: bool) -> str:
    labels = scores.select("row_idx", argmax(F.col("logits")).alias("prediction"))
    _require_positions(labels, f"{run_id}, {split}")
    folder = f"{output}/{split}"
    write_label_lines(labels, folder, single_file=single_file)
    return folder
