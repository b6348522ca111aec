"""Error analysis of predictions by length, grade and keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.bins import BUCKET_EDGES, length_bucket
from gradeloom.functions.text import MISSING_TEXT_LENGTH, MISSING_TEXT_WORDS, text_length, word_count
from gradeloom.operators.joins import attach_by_position, merge_with_labels
from gradeloom.operators.metrics import CELLS, GRADES, binary_cells, classification_metrics
from gradeloom.operators.row_index import with_row_index


def corpus_features(corpus: DataFrame) -> DataFrame:
    """Corpus rows with their place, and the length and word count of the text instead of the text."""
    return corpus.select(
        "par_id",
        "keyword",
        text_length(F.col("text")).alias("text_length"),
        word_count(F.col("text")).alias("word_count"),
        "label",
        F.monotonically_increasing_id().alias("_corpus_place"),
    )


def gold_rows(split: DataFrame, corpus: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of a split list with both label forms and the text features.

    The features are taken before the join, so that no text is shuffled.  A list with
    ``row_idx`` is numbered anew after the join, since an id with several corpus rows
    gives as many rows: in the order of the list and then of the corpus.
    """
    merged = merge_with_labels(split, corpus_features(corpus), labels="both", keep_keyword=True, strict=strict)
    missing = {"text_length": MISSING_TEXT_LENGTH, "word_count": MISSING_TEXT_WORDS}
    merged = merged.fillna(missing)
    if "row_idx" in merged.columns:
        merged = with_row_index(merged, "row_idx", "_corpus_place")
    return merged.drop("_corpus_place")


def evaluated_rows(split: DataFrame, corpus: DataFrame, predictions: DataFrame, strict: bool = True) -> DataFrame:
    """Gold rows with their predictions; the basis of all reports.

    There have to be as many predictions as rows.
    """
    return attach_by_position(gold_rows(split, corpus, strict), predictions, exact=True)


def error_slices(evaluated: DataFrame) -> DataFrame:
    """All rows, length buckets, grades and keywords in one aggregation.

    ``slice`` names the kind of a row and ``value`` which one it is.  Length buckets
    and grades without rows are listed with zeros.  Rows without keyword are in no
    keyword slice.
    """
    rows = evaluated.select(
        length_bucket(F.col("text_length")).alias("bucket"), "graded", "keyword", "text_length", "label", "prediction"
    )
    sets = [[], ["bucket"], ["graded"], ["keyword"]]
    counts = rows.groupingSets(sets, "bucket", "graded", "keyword").agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("n"),
        F.min("text_length").alias("min_length"),
        F.max("text_length").alias("max_length"),
        *binary_cells(),
    )
    # One bit per column, set where the column is not part of the slice.
    kinds = {
        0b111: ("all", F.lit("all")),
        0b011: ("length", F.col("bucket")),
        0b101: ("grade", F.col("graded")),
        0b110: ("keyword", F.col("keyword")),
    }
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bits, (name, column) in kinds.items():
        chosen = F.col("_set") == bits
        kind = F.when(chosen, F.lit(name)).otherwise(kind)
        value = F.when(chosen, column.cast("string")).otherwise(value)
    named = counts.select(kind.alias("slice"), value.alias("value"), "n", "min_length", "max_length", *CELLS)
    listed = [("length", str(b)) for b in range(1, len(BUCKET_EDGES) + 2)] + [("grade", str(g)) for g in GRADES]
    nothing = evaluated.sparkSession.createDataFrame(listed, "slice string, value string").withColumns(
        {name: F.lit(0).cast("long") for name in ("n", *CELLS)}
    )
    every = named.filter(F.col("value").isNotNull()).unionByName(nothing, allowMissingColumns=True)
    sums = [F.sum(name).alias(name) for name in ("n", *CELLS)]
    lengths = [F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length")]
    # One row per slice and, of the listed ones, a second.
    whole = every.groupBy("slice", "value").agg(*sums, *lengths)
    return classification_metrics(whole.select("slice", "value", "n", "min_length", "max_length", *CELLS))
