"""Joins of split lists, corpora, predictions and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.arrays import cosine
from gradeloom.functions.labels import binarize, graded_label, prediction_as_string

KEY = "par_id"
_DROPPED = ("art_id", "country_code")


def resolve_label_columns(split: DataFrame, corpus: DataFrame, keep_keyword: bool = False) -> DataFrame:
    """Left join on the key with one label and one text.

    The label of the split list is dropped for that of the corpus.  A text of
    the left side wins over that of the corpus, even where it is null.
    """
    dropped = set(_DROPPED) if keep_keyword else {*_DROPPED, "keyword"}
    left = [c for c in split.columns if c not in (KEY, "label", *dropped)]
    right = [c for c in corpus.columns if c != KEY and c not in dropped and c not in left]
    joined = split.alias("s").join(corpus.select(KEY, *right).alias("c"), KEY, "left")
    return joined.select(KEY, *[F.col(f"s.{c}") for c in left], *[F.col(f"c.{c}") for c in right])


def merge_with_labels(
    split: DataFrame,
    corpus: DataFrame,
    labels: str = "binary",
    keep_keyword: bool = False,
    threshold: int = 1,
    strict: bool = True,
) -> DataFrame:
    """Look up the corpus rows of a split list.

    ``labels`` is "binary" or "graded" for the form of the label column, or
    "both" for a binary ``label`` and a ``graded`` column from one join.
    Columns of the list such as ``row_idx`` are carried along.
    """
    merged = resolve_label_columns(split, corpus, keep_keyword)
    label = F.col("label")
    forms = {
        "binary": {"label": binarize(label, threshold)},
        "graded": {"label": graded_label(label, strict)},
        "both": {"graded": graded_label(label, strict), "label": binarize(label, threshold)},
    }
    return merged.withColumns(forms[labels])


def label_augmented(augmented: DataFrame, corpus: DataFrame, threshold: int = 1) -> DataFrame:
    """Give augmented texts the binary label of the corpus row they came from.

    Rows with an ``error`` have no text of their own and are left out.
    """
    if "error" in augmented.columns:
        augmented = augmented.filter(F.col("error").isNull()).drop("error")
    own_text = "text" in augmented.columns
    looked_up = [c for c in corpus.columns if c in (KEY, "label") or (c == "text" and not own_text)]
    return merge_with_labels(augmented, corpus.select(*looked_up), threshold=threshold)


def attach_by_position(
    gold: DataFrame, predictions: DataFrame, key: str | None = None, exact: bool = False
) -> DataFrame:
    """Give the i-th gold row the i-th prediction, from a ``prediction`` or ``value`` column.

    A gold row without prediction fails.  Surplus predictions are ignored, or with
    ``exact`` fail too.  With ``key``, rows that share it all take the prediction of the
    last of them.
    """
    said = F.col("prediction" if "prediction" in predictions.columns else "value")
    lines = predictions.select("row_idx", prediction_as_string(said).alias("prediction"))
    if exact:
        known = gold.select(F.col("row_idx").alias("_gold"))
        surplus = F.raise_error(F.concat(F.lit("no row for prediction "), F.col("row_idx").cast("string")))
        checked = lines.join(known, F.col("row_idx") == F.col("_gold"), "left")
        lines = checked.select(F.coalesce("_gold", surplus.cast("long")).alias("row_idx"), "prediction")
    attached = gold.join(lines, "row_idx", "left")
    if key is not None:
        last = attached.groupBy(key).agg(F.max_by("prediction", "row_idx").alias("prediction"))
        attached = attached.drop("prediction").join(last, key, "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for row "), F.col("row_idx").cast("string")))
    return attached.withColumn("prediction", F.coalesce("prediction", missing.cast("string")))


def anti_join_by_key(df: DataFrame, taken: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key occurs nowhere in ``taken``; null counts as a key like any other."""
    keys = taken.select(F.col(key).alias("_taken")).distinct()
    return df.join(keys, F.col(key).eqNullSafe(F.col("_taken")), "left_anti")


def vector_pairs(pairs: DataFrame, vectors: DataFrame, left: str, right: str, key: str, vector: str) -> DataFrame:
    """Look up both vectors of a pair of keys and add their similarity.

    A pair with an unknown key fails.
    """

    def side(column: str, alias: str) -> DataFrame:
        return vectors.select(F.col(key).alias(column), F.col(vector).alias(alias))

    looked_up = pairs.join(side(left, "_a"), left, "left").join(side(right, "_b"), right, "left")
    found = {"_a": _required("_a", left), "_b": _required("_b", right)}
    return looked_up.withColumn("similarity", cosine(found["_a"], found["_b"])).drop("_a", "_b")


def _required(vector: str, key: str) -> Column:
    unknown = F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string")))
    return F.when(F.col(vector).isNull(), unknown.cast("array<double>")).otherwise(
        F.col(vector).cast("array<double>")
    )
