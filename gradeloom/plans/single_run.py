"""One run from training rows to a stored model: train, score the dev rows, store what is good enough."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.labels import prediction_as_string
from gradeloom.operators import classifier
from gradeloom.operators.metrics import GOOD_F1, confusion_matrix, evaluate_scores
from gradeloom.sources.run_store import commit_run
from gradeloom.staging import stage


@dataclass(frozen=True)
class SingleRun:
    """``log`` by epoch, metrics and confusion matrix of the dev rows, and the attempt that was committed, if any."""

    model: classifier.LinearModel
    log: DataFrame
    metrics: DataFrame
    matrix: DataFrame
    attempt: str | None


def single_run(
    train: DataFrame,
    valid: DataFrame,
    dev: DataFrame,
    final: DataFrame,
    output: str,
    run_id: str,
    min_f1: float = GOOD_F1,
    **training,
) -> SingleRun:
    """Train on ``train`` and ``valid``; if the F1 on ``dev`` is above ``min_f1``, commit the run to ``output``.

    The stored scores are those of ``dev`` (split "valid", with labels) and of ``final``; both need a
    ``row_idx`` and a ``text``.  A run that is repeated takes the place of the one before.
    """
    model, log = classifier.train_text_classifier(train, valid, **training)
    scored = stage(classifier.score(model, dev).select("row_idx", "label", "logits", "prediction"), "scores")
    measured = evaluate_scores(scored)
    matrix = confusion_matrix(scored.withColumn("prediction", prediction_as_string(F.col("prediction"))))
    row = measured.first()
    attempt = None
    if row["f1_score"] > min_f1:
        on_valid = log.orderBy("eval_loss", "epoch").first()
        metrics = {"valid_f1": on_valid["eval_f1"], "dev_f1": row["f1_score"], "dev_accuracy": row["accuracy"]}
        scores = {"valid": scored, "final": classifier.score(model, final)}
        attempt = commit_run(output, run_id, scores, metrics, training, weights=model.weights, min_f1=min_f1)
    return SingleRun(model, log, measured, matrix, attempt)
