"""What the annotated data look like: classes, lengths, word counts and keywords of train and dev rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.metrics import class_counts, histogram_bins, keyword_counts, keyword_label_pivot, positive_rate_by_bin
from gradeloom.operators.sampling import concat
from gradeloom.plans.error_report import gold_rows
from gradeloom.staging import stage


@dataclass(frozen=True)
class DataReport:
    classes: DataFrame
    positive_rate: DataFrame
    word_counts: DataFrame
    keywords: DataFrame
    grades: DataFrame


def data_report(train: DataFrame, dev: DataFrame, corpus: DataFrame) -> DataReport:
    """Reports over both split lists; ``grades``, the keywords by graded label, are of the train list only.

    Texts are read once: only their length and word count are joined and written.
    """
    sides = (gold_rows(df, corpus, strict=False).withColumn("in_train", F.lit(of_train)) for df, of_train in ((train, True), (dev, False)))
    rows = stage(concat(*sides), "report")
    trained = rows.filter("in_train").select("keyword", F.col("graded").alias("label")).filter(F.col("label").isNotNull())
    return DataReport(
        classes=class_counts(rows),
        positive_rate=positive_rate_by_bin(rows),
        word_counts=histogram_bins(rows, "word_count"),
        keywords=keyword_counts(rows),
        grades=keyword_label_pivot(trained),
    )
