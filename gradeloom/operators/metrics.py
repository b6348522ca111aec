"""Confusion counts, metrics and the reports sliced by length, grade and keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.arrays import argmax
from gradeloom.functions.bins import BIN_EDGES, BUCKET_EDGES, cut, length_bucket
from gradeloom.functions.labels import graded_positive, prediction_as_string
from gradeloom.functions.text import text_length
from gradeloom.staging import stage

# The grades that are always listed, and the bar for a good run.
GRADES = (0, 1, 2, 3, 4)
GOOD_F1 = 0.55
CELLS = ("tp", "tn", "fn", "fp")
METRICS = ("recall", "precision", "f1_score", "accuracy")


def _cells(positive: Column, negative: Column) -> list[Column]:
    """The four counts; rows that are neither positive nor negative count nowhere."""
    said_yes, said_no = F.col("prediction") == "1", F.col("prediction") == "0"
    counted = (said_yes & positive, said_no & negative, said_no & positive, said_yes & negative)
    return [F.count_if(cell).alias(name) for name, cell in zip(CELLS, counted)]


def binary_cells() -> list[Column]:
    return _cells(F.col("label") == 1, F.col("label") == 0)


def graded_cells(cutoff: int = 1) -> list[Column]:
    positive = graded_positive(F.col("label"), cutoff)
    return _cells(positive, ~positive)


def confusion_counts(df: DataFrame, *by: str) -> DataFrame:
    """TP, TN, FN and FP of string predictions against 0/1 labels, in one scan."""
    return df.groupBy(*by).agg(*binary_cells())


def confusion_counts_graded(df: DataFrame, *by: str, cutoff: int = 1) -> DataFrame:
    """The same against the truth ``label > cutoff``."""
    return df.groupBy(*by).agg(*graded_cells(cutoff))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Recall, precision, F1 and accuracy of the counted rows; 0 without a basis."""
    tp, tn, fn, fp = (F.col(cell) for cell in CELLS)
    rates = counts.withColumns(
        {
            "recall": _ratio(tp, tp + fn),
            "precision": _ratio(tp, tp + fp),
            "accuracy": _ratio(tp + tn, tp + tn + fn + fp),
        }
    )
    recall, precision = F.col("recall"), F.col("precision")
    f1 = _ratio(2 * (precision * recall), precision + recall)
    rest = [c for c in counts.columns if c not in METRICS]
    return rates.withColumn("f1_score", f1).select(*rest, *METRICS)


def _fill_counts(df: DataFrame, *names: str) -> DataFrame:
    return df.fillna(0, subset=list(names))


def _listed(df: DataFrame, **columns: Sequence[int]) -> DataFrame:
    """A small table with one int column per argument."""
    size = len(next(iter(columns.values())))
    rows = df.sparkSession.range(size)
    return rows.select(
        *[F.array(*map(F.lit, values))[F.col("id").cast("int")].alias(name) for name, values in columns.items()]
    )


def metrics_by_length(df: DataFrame, edges: Sequence[int] = BUCKET_EDGES) -> DataFrame:
    """Metrics per length bucket; empty buckets are listed with null lengths.

    Uses a ``text_length`` column if there is one, else the text.
    """
    length = F.col("text_length") if "text_length" in df.columns else text_length(F.col("text"))
    rows = df.select("label", "prediction", length.alias("text_length"))
    counts = rows.groupBy(length_bucket(F.col("text_length"), edges).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.min("text_length").alias("min_length"),
        F.max("text_length").alias("max_length"),
        *binary_cells(),
    )
    # One row per bucket on both sides.
    listed = _listed(df, bucket=range(1, len(edges) + 2)).join(F.broadcast(counts), "bucket", "left")
    return classification_metrics(_fill_counts(listed, "n", *CELLS)).orderBy("bucket")


def metrics_by_graded_label(df: DataFrame, grades: Sequence[int] = GRADES, cutoff: int = 1) -> DataFrame:
    """Metrics per graded label; empty grades are listed."""
    counts = (
        df.filter(F.col("label").isin(*grades))
        .groupBy("label")
        .agg(F.count("*").alias("n"), *graded_cells(cutoff))
    )
    # One row per grade on both sides.
    listed = _listed(df, label=grades).join(F.broadcast(counts), "label", "left")
    return classification_metrics(_fill_counts(listed, "n", *CELLS)).orderBy("label")


def metrics_by_keyword(df: DataFrame) -> DataFrame:
    """Metrics per keyword, best F1 first; rows without keyword are left out."""
    counts = (
        df.filter(F.col("keyword").isNotNull())
        .groupBy("keyword")
        .agg(F.count("*").alias("n"), *binary_cells())
    )
    return sort_by_metric(classification_metrics(counts), "f1_score", "keyword")


def sort_by_metric(df: DataFrame, metric: str, *tie_break: str) -> DataFrame:
    """Highest value first; the tie-break makes the order total."""
    return df.orderBy(F.desc(metric), *tie_break)


def class_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"))


def _label_counts(labels: Sequence[int], prefix: str) -> list[Column]:
    return [F.count_if(F.col("label") == label).alias(f"{prefix}{label}") for label in labels]


def positive_rate_by_bin(df: DataFrame, edges: Sequence[int] = BIN_EDGES) -> DataFrame:
    """Label counts and share of positives in percent per length bin.

    Lengths outside of the bins are left out; empty bins are listed with a null
    share.
    """
    length = F.col("text_length") if "text_length" in df.columns else text_length(F.col("text"))
    rows = df.select("label", cut(length, edges).alias("bin")).filter(F.col("bin").isNotNull())
    counts = rows.groupBy("bin.bin_left", "bin.bin_right").agg(*_label_counts((0, 1), "n"))
    # One row per bin on both sides.
    bins = _listed(df, bin_left=edges[:-1], bin_right=edges[1:])
    listed = _fill_counts(bins.join(F.broadcast(counts), ["bin_left", "bin_right"], "left"), "n0", "n1")
    share = F.try_divide("n1", F.col("n0") + F.col("n1")) * 100
    return listed.withColumn("ratio", share).orderBy("bin_left")


def keyword_counts(df: DataFrame) -> DataFrame:
    counts = df.filter(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.count("*").alias("n"))
    return sort_by_metric(counts, "n", "keyword")


def keyword_label_pivot(df: DataFrame, grades: Sequence[int] = GRADES) -> DataFrame:
    """One row per keyword, one count column for each of ``grades`` and each further label that occurs."""
    rows = df.filter(F.col("keyword").isNotNull())
    # As many rows as there are different labels, like the columns of the result.
    found = [label for (label,) in rows.select("label").distinct().collect() if label is not None]
    return rows.groupBy("keyword").agg(*_label_counts(sorted({*grades, *found}), "label_"))


def histogram_by_class(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram per label; both labels share the edges.

    The last bin is closed.  If all values are equal, the range is widened by
    a half on both sides.
    """
    value = F.col(column).cast("double").alias("value")
    rows = df.select("label", value).filter(F.col("label").isNotNull() & F.col("value").isNotNull())
    # Written, so that the edges and the bins come from one pass over the rows.
    counts = stage(rows.groupBy("value", "label").agg(F.count("*").alias("n")), "values")
    flat = F.when(F.min("value") == F.max("value"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = counts.agg((F.min("value") - flat).alias("lo"), (F.max("value") + flat).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    number = F.least(F.width_bucket("value", lo, hi, F.lit(bins)), F.lit(bins)).cast("int")
    return counts.groupBy(number.alias("bin"), "label").agg(F.sum("n").alias("n"))


def histogram_bins(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """The same with all bins of the labels 0 and 1, empty ones too, and their edges as ``bin_left`` and ``bin_right``.

    A table without values has no edges and no bins.
    """
    counts = stage(histogram_by_class(df, column, bins), "bins")
    value = F.col(column).cast("double")
    flat = F.when(F.min(value) == F.max(value), F.lit(0.5)).otherwise(F.lit(0.0))
    rows = df.filter(F.col("label").isNotNull() & value.isNotNull())
    span = rows.agg((F.min(value) - flat).alias("lo"), (F.max(value) + flat).alias("hi")).filter("lo IS NOT NULL")
    listed = span.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    listed = listed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    edge = lambda at: F.col("lo") + (F.col("hi") - F.col("lo")) * at / bins
    edges = {"bin_left": edge(F.col("bin") - 1), "bin_right": edge(F.col("bin"))}
    found = listed.withColumns(edges).join(counts, ["bin", "label"], "left")
    return found.select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "bin_left", "bin_right")


def confusion_matrix(df: DataFrame) -> DataFrame:
    """One row per true label 0 and 1, one column per predicted label."""
    predicted = prediction_as_string(F.col("prediction"))
    cells = [F.count_if(predicted == p).alias(f"predicted_{p}") for p in ("0", "1")]
    counts = df.filter(F.col("label").isin(0, 1)).groupBy("label").agg(*cells)
    # At most two rows on both sides.
    listed = _listed(df, label=(0, 1)).join(F.broadcast(counts), "label", "left")
    return _fill_counts(listed, "predicted_0", "predicted_1").orderBy("label")


def evaluate_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Counts, F1 of class 1 and accuracy of the highest-scored classes."""
    predicted = scores.withColumn("prediction", prediction_as_string(argmax(F.col("logits"))))
    return classification_metrics(confusion_counts(predicted, *by))


def select_runs(runs: DataFrame, min_f1: float = GOOD_F1, split: str | None = None) -> DataFrame:
    """Runs whose F1 is above the bar, on one split if the table has several."""
    chosen = runs if split is None else runs.filter(F.col("split") == split)
    return chosen.filter(F.col("f1") > min_f1)


def best_run(runs: DataFrame, metric: str = "f1", split: str | None = None) -> DataFrame:
    """The run with the highest metric; the smallest run id on ties."""
    chosen = runs if split is None else runs.filter(F.col("split") == split)
    return chosen.orderBy(F.desc(metric), "run_id").limit(1)
