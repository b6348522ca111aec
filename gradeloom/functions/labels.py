"""Label and prediction columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def binarize(label: Column, threshold: int = 1) -> Column:
    """1 above the threshold, else 0; a missing label counts as 0."""
    return F.coalesce(label > threshold, F.lit(False)).cast("int")


def graded_label(label: Column, strict: bool = True) -> Column:
    """Label as int. A missing label fails in strict mode and stays null otherwise."""
    if not strict:
        return label.cast("int")
    missing = F.raise_error(F.lit("graded label is missing")).cast("int")
    return F.when(label.isNull(), missing).otherwise(label.cast("int"))


def graded_positive(label: Column, cutoff: int = 1) -> Column:
    """Truth of a graded label: above the cutoff."""
    return label > cutoff


def prediction_as_string(prediction: Column) -> Column:
    """Predictions are stored and compared as the strings "0" and "1"."""
    return prediction.cast("string")
