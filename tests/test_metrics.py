import math

import numpy as np
import pytest

from gradeloom.functions.bins import BIN_EDGES
from gradeloom.operators import joins, metrics
from gradeloom.plans.error_report import error_slices, evaluated_rows

CORPUS = [
    (1, "a1", "women", "gb", "x" * 128, 0),
    (2, "a2", "women", "us", "x" * 129, 1),
    (3, "a3", "poor", "us", None, 3),
    (4, "a4", None, "ke", "x " * 700, 4),
    (5, "a5", "poor", "ke", "one two", 2),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        CORPUS, "par_id bigint, art_id string, keyword string, country_code string, text string, label int"
    )


def split(spark, ids):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(ids)], "row_idx bigint, par_id bigint, label string")


def predictions(spark, said):
    return spark.createDataFrame(list(enumerate(said)), "row_idx bigint, prediction int")


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_merge_keeps_order_and_all_matches(spark, corpus):
    twice = corpus.union(corpus.filter("par_id = 2"))
    merged = joins.merge_with_labels(split(spark, [5, 2, 9]), twice).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["par_id"], r["label"]) for r in merged] == [(0, 5, 1), (1, 2, 0), (1, 2, 0), (2, 9, 0)]
    assert merged[0].asDict().keys() == {"par_id", "row_idx", "text", "label"}


def test_graded_merge_fails_without_corpus_row(spark, corpus):
    with pytest.raises(Exception, match="graded label is missing"):
        joins.merge_with_labels(split(spark, [9]), corpus, labels="graded").collect()
    lenient = joins.merge_with_labels(split(spark, [9, 3]), corpus, labels="both", strict=False, keep_keyword=True)
    assert [(r["graded"], r["label"], r["keyword"]) for r in lenient.orderBy("row_idx").collect()] == [
        (None, 0, None),
        (3, 1, "poor"),
    ]


def test_left_text_wins_even_when_missing(spark, corpus):
    own = spark.createDataFrame([(1, "x", None), (5, "y", "mine")], "par_id bigint, label string, text string")
    labelled = by(joins.label_augmented(own, corpus), "par_id")
    assert (labelled[1]["text"], labelled[5]["text"], labelled[5]["label"]) == (None, "mine", 1)
    borrowed = by(joins.label_augmented(own.drop("text"), corpus), "par_id")
    assert borrowed[5]["text"] == "one two"


def test_predictions_by_position(spark, corpus):
    gold = joins.merge_with_labels(split(spark, [5, 1, 5]), corpus)
    attached = joins.attach_by_position(gold, predictions(spark, [1, 0, 0, 1]))
    assert [r["prediction"] for r in attached.orderBy("row_idx").collect()] == ["1", "0", "0"]
    shared = joins.attach_by_position(gold, predictions(spark, [1, 0, 0, 1]), key="par_id")
    assert [r["prediction"] for r in shared.orderBy("row_idx").collect()] == ["0", "0", "0"]
    with pytest.raises(Exception, match="no prediction for row 2"):
        joins.attach_by_position(gold, predictions(spark, [1, 0])).collect()


def test_unknown_word_of_a_pair_fails(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string")
    got = by(joins.vector_pairs(pairs, vectors, "a", "b", "word", "vector"), "b")
    assert got["b"]["similarity"] == pytest.approx(math.sqrt(0.5)) and got["a"]["similarity"] == pytest.approx(1)
    with pytest.raises(Exception, match="no vector for z"):
        unknown = spark.createDataFrame([("a", "z")], "a string, b string")
        joins.vector_pairs(unknown, vectors, "a", "b", "word", "vector").collect()


def evaluated(spark, rows):
    """Rows of (label, prediction, text)."""
    return spark.createDataFrame(rows, "label int, prediction string, text string")


def test_other_predictions_and_labels_count_nowhere(spark):
    df = evaluated(spark, [(1, "1", ""), (0, "0", ""), (1, "0", ""), (0, "1", ""), (1, "yes", ""), (2, "1", ""), (0, None, "")])
    assert tuple(metrics.confusion_counts(df).head()) == (1, 1, 1, 1)
    assert tuple(metrics.confusion_counts_graded(df).head()) == (1, 2, 0, 2)


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([], (0.0, 0.0, 0.0, 0.0)),
        ([(0, "0", "")], (0.0, 0.0, 0.0, 1.0)),
        ([(1, "0", ""), (0, "1", "")], (0.0, 0.0, 0.0, 0.0)),
        ([(1, "1", ""), (1, "0", ""), (0, "0", ""), (0, "1", "")], (0.5, 0.5, 0.5, 0.5)),
    ],
)
def test_metrics_without_a_basis_are_zero(spark, rows, wanted):
    result = metrics.classification_metrics(metrics.confusion_counts(evaluated(spark, rows))).head()
    assert tuple(result[name] for name in metrics.METRICS) == wanted


def test_empty_buckets_and_grades_are_listed(spark):
    df = evaluated(spark, [(1, "1", None), (0, "1", "x" * 513), (3, "0", "x" * 2000)])
    by_length = metrics.metrics_by_length(df).collect()
    assert [(r["bucket"], r["n"], r["min_length"], r["max_length"]) for r in by_length] == [
        (1, 1, 3, 3), (2, 0, None, None), (3, 0, None, None), (4, 0, None, None), (5, 2, 513, 2000),
    ]
    assert [(r["label"], r["n"], r["accuracy"]) for r in metrics.metrics_by_graded_label(df).collect()] == [
        (0, 1, 0.0), (1, 1, 0.0), (2, 0, 0.0), (3, 1, 0.0), (4, 0, 0.0),
    ]
    assert [tuple(r) for r in metrics.confusion_matrix(df.filter("label = 0")).collect()] == [(0, 0, 1), (1, 0, 0)]


def test_positive_rate_per_bin(spark):
    rng = np.random.default_rng(3)
    rows = list(zip(rng.integers(0, 2, 400).tolist(), rng.choice([0, 1, 128, 129, 300, 1500, 1501], 400).tolist()))
    got = metrics.positive_rate_by_bin(spark.createDataFrame(rows, "label int, text_length int")).collect()
    assert len(got) == 5
    for row, left, right in zip(got, BIN_EDGES, BIN_EDGES[1:]):
        inside = [label for label, length in rows if left < length <= right]
        ones = sum(inside)
        assert (row["bin_left"], row["bin_right"], row["n0"], row["n1"]) == (left, right, len(inside) - ones, ones)
        assert row["ratio"] == (pytest.approx(100 * ones / len(inside)) if inside else None)
    assert got[3]["ratio"] is None


@pytest.mark.parametrize("values", [list(range(97)) + [5] * 20, [7] * 5, [0.1, 0.2, 0.30000000000000004, 1.0]])
def test_histogram_equals_numpy(spark, values):
    rows = [(i % 2, float(v)) for i, v in enumerate(values)]
    got = metrics.histogram_by_class(spark.createDataFrame(rows, "label int, v double"), "v").collect()
    edges = np.histogram_bin_edges(values, bins=40)
    for label in (0, 1):
        counts, _ = np.histogram([v for l, v in rows if l == label], bins=edges)
        assert {r["bin"]: r["n"] for r in got if r["label"] == label} == {i + 1: c for i, c in enumerate(counts) if c}


def test_keywords_are_sorted_by_f1_then_name(spark):
    rows = [("b", 1, "1"), ("a", 1, "1"), ("c", 1, "0"), (None, 1, "1")]
    df = spark.createDataFrame(rows, "keyword string, label int, prediction string")
    assert [(r["keyword"], r["n"]) for r in metrics.metrics_by_keyword(df).collect()] == [("a", 1), ("b", 1), ("c", 1)]
    assert [r["keyword"] for r in metrics.keyword_counts(df).collect()] == ["a", "b", "c"]
    pivot = by(metrics.keyword_label_pivot(df), "keyword")
    assert pivot["a"].asDict() == {"keyword": "a", "label_0": 0, "label_1": 1, "label_2": 0, "label_3": 0, "label_4": 0}


def test_runs_need_more_than_the_bar(spark):
    runs = spark.createDataFrame(
        [("b", "dev", 0.55), ("a", "dev", 0.56), ("d", "valid", 0.9), ("c", "valid", 0.9)], "run_id string, split string, f1 double"
    )
    assert [r["run_id"] for r in metrics.select_runs(runs, split="dev").collect()] == ["a"]
    assert metrics.best_run(runs).head()["run_id"] == "c"
    assert metrics.best_run(runs, split="dev").head()["run_id"] == "a"


def test_slices_add_up(spark, corpus):
    gold = split(spark, [1, 2, 3, 4, 5])
    rows = evaluated_rows(gold, corpus, predictions(spark, [1, 0, 1, 1, 0]))
    slices = error_slices(rows).collect()
    whole = next(r for r in slices if r["slice"] == "all")
    assert (whole["n"], whole["tp"], whole["tn"], whole["fn"], whole["fp"]) == (5, 2, 1, 1, 1)
    for kind, rows_in in (("length", 5), ("grade", 5), ("keyword", 4)):
        parts = [r for r in slices if r["slice"] == kind]
        assert sum(r["n"] for r in parts) == rows_in
        if kind != "keyword":
            assert all(sum(r[cell] for r in parts) == whole[cell] for cell in metrics.CELLS)
    buckets = {r["value"]: r for r in slices if r["slice"] == "length"}
    assert (buckets["1"]["n"], buckets["1"]["min_length"]) == (3, 3) and buckets["5"]["max_length"] == 1400


def test_missing_corpus_rows_have_the_text_nan(spark, corpus):
    rows = evaluated_rows(split(spark, [9]), corpus, predictions(spark, [1]), strict=False).collect()
    assert [(r["text_length"], r["word_count"], r["label"], r["graded"]) for r in rows] == [(3, 1, 0, None)]
