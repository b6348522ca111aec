"""From corpus and split lists to training and validation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.joins import label_augmented, merge_with_labels
from gradeloom.operators.sampling import SEED, concat, rebalance, split_train_valid, with_row_key
from gradeloom.staging import stage


@dataclass
class TrainingSets:
    """Training and validation rows, and what they were drawn from, that without texts."""

    train: DataFrame
    valid: DataFrame
    rebalanced: DataFrame


def training_sets(
    train_labels: DataFrame,
    corpus: DataFrame,
    augmented: DataFrame,
    down_ratio: float = 3,
    up_ratio: float = 2.5,
    train_frac: float = 0.8,
    seed: int = SEED,
) -> TrainingSets:
    """Label the split list, rebalance it and split it by id.

    All draws work on ids and labels and carry the number of the labelled row; the
    texts of the drawn rows are joined last by that number, once for both sets.
    """
    labelled = _numbered(merge_with_labels(train_labels, corpus), "orig")
    extra = _numbered(label_augmented(augmented, corpus), "aug")
    rebalanced = stage(rebalance(labelled.drop("text"), extra.drop("text"), down_ratio, up_ratio, seed), "rebalanced")
    train, valid = split_train_valid(rebalanced, train_frac, seed)
    rows = concat(train.withColumn("side", F.lit("train")), valid.withColumn("side", F.lit("valid")))
    texts = concat(*(part.select("_labelled", "text") for part in (labelled, extra)))
    sides = stage(rows.join(texts, "_labelled").drop("_labelled"), "sides", partition_by="side")
    return TrainingSets(
        *[sides.filter(F.col("side") == side).drop("side") for side in ("train", "valid")], rebalanced.drop("_labelled")
    )


def _numbered(rows: DataFrame, origin: str) -> DataFrame:
    """Rows written once with their key and with a number of their own."""
    number = F.concat(F.lit(f"{origin} "), F.monotonically_increasing_id().cast("string"))
    return stage(with_row_key(rows, origin).withColumn("_labelled", number), "labelled")
