import numpy as np
import pyarrow as pa
import pytest

from gradeloom.llm import language_id as lid
from gradeloom.llm.queries import op6_language_id


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    weights = lid.new_weights(3, 4, 1, np.float64)
    steps = rng.integers(0, 256, (7, 5))
    steps[4:, 0] = 256
    labels = rng.integers(0, 4, 5)
    _, gradient = lid.loss_and_gradient(weights, steps, labels)
    for name, values in weights.items():
        places = [tuple(rng.integers(0, s) for s in values.shape) for _ in range(6)]
        if name.endswith("_bytes"):
            places = [(int(rng.choice(steps[steps < 256])), p[1]) for p in places]
        for place in places:
            changed = []
            for step in (1e-6, -1e-6):
                other = {k: v.copy() for k, v in weights.items()}
                other[name][place] += step
                changed.append(lid.loss_and_gradient(other, steps, labels)[0])
            assert (changed[0] - changed[1]) / 2e-6 == pytest.approx(gradient[name][place], abs=1e-6), name


def test_padding_changes_nothing():
    weights = lid.new_weights(4, 3, 2, np.float64)
    steps = np.random.default_rng(1).integers(0, 256, (5, 2))
    padded = np.concatenate([steps, np.full((3, 2), 256)])
    assert lid.probabilities(weights, padded)[0][:5] == pytest.approx(lid.probabilities(weights, steps)[0])


def test_scoring_equals_the_network_that_is_trained():
    model = lid.LanguageModel(["de", "en", "fr"], lid.new_weights(4, 3, 2, np.float64))
    texts = ["abcdefghij", "", "éü" * 7, "x"]
    means = lid._means(model, pa.array(texts), 8)
    for text, mean in zip(texts, means):
        data = text.encode()
        windows = [data[i : i + 8] for i in range(0, len(data), 8)]
        probs = [lid.probabilities(model.weights, np.frombuffer(w, np.uint8).astype(int)[:, None])[0][:, 0] for w in windows]
        assert mean == pytest.approx(np.concatenate(probs).mean(axis=0) if probs else np.zeros(3))


def test_cases_without_language(spark, table):
    rows = [(1, None), (2, ""), (3, " 12 !?"), (4, "é"), (5, "the words " * 20_000), (5, "the words"), (None, "das")]
    model = lid.LanguageModel(["de", "en"], lid.new_weights(4, 2, 3))
    got = lid.identify_language(table(rows), model).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row.lang_pred == "und") == (row.doc_id in (1, 2, 3)) and 0 <= row.score <= 1
    nothing = lid.train_language_model(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in lid.identify_language(table(rows), nothing).collect()} == {"und"}
    empty = spark.createDataFrame([], "doc_id long, text string, score string")
    assert lid.identify_language(empty, model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op6_language_id(spark, folder).filter("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
