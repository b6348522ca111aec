import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import arrays, bins, labels, text


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], f"i int, x {schema}")
    return [row[0] for row in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_binarize_takes_missing_labels_for_negative(spark):
    assert values(spark, [None, 0, 1, 2, 4], "int", labels.binarize) == [0, 0, 0, 1, 1]


def test_graded_label_is_strict_about_missing_labels(spark):
    assert values(spark, [0.0, 4.0], "double", labels.graded_label) == [0, 4]
    assert values(spark, [None, 3], "int", lambda c: labels.graded_label(c, strict=False)) == [None, 3]
    with pytest.raises(Exception, match="graded label is missing"):
        values(spark, [None, 3], "int", labels.graded_label)


def test_missing_text_reads_nan(spark):
    rows = [None, "", "a\U0001f600b"]
    assert values(spark, rows, "string", text.text_or_nan) == ["nan", "", "a\U0001f600b"]
    assert values(spark, rows, "string", text.text_length) == [3, 0, 3]


def test_word_count_splits_where_python_does(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = ["", "   ", " one two ", "a b c　d", "e\x1cf\x85g", "".join(f"w{s}" for s in spaces), "x​y"]
    assert values(spark, rows, "string", text.word_count) == [len(row.split()) for row in rows]
    assert values(spark, [None], "string", text.word_count) == [1]
    with pytest.raises(Exception, match="missing text"):
        values(spark, [None], "string", lambda c: text.word_count(c, strict=True))


def test_edges_belong_to_the_lower_bucket(spark):
    lengths = [0, 1, 128, 129, 256, 257, 384, 385, 512, 513, 1500, 1501]
    assert values(spark, lengths, "int", bins.length_bucket) == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    cut = values(spark, lengths, "int", bins.cut)
    expected = pd.cut(pd.Series(lengths), bins=list(bins.BIN_EDGES))
    assert [tuple(c) if c else None for c in cut] == [(i.left, i.right) if isinstance(i, pd.Interval) else None for i in expected]


def test_bin_labels(spark):
    row = spark.range(1).select(
        bins.bin_label(F.lit(0), F.lit(128)), bins.range_label(F.lit(2.5), F.lit(127)), bins.range_label(F.lit(None), F.lit(1))
    ).head()
    assert tuple(row) == ("0 - 128", "2-127", None)


def test_argmax_takes_the_first_maximum(spark):
    rows = [[0.5, 0.5], [0.1, 0.2], [-1.0, -2.0], [1.0, math.nan]]
    assert values(spark, rows, "array<double>", arrays.argmax) == [int(np.argmax(row)) for row in rows]


def test_cosine(spark):
    rows = [[1.0, 0.0], [3.0, 4.0], [0.0, 0.0]]
    got = values(spark, rows, "array<double>", lambda c: arrays.cosine(c, F.array(F.lit(1.0), F.lit(0.0))))
    assert got == [1.0, 0.6, None]


def test_every_nth(spark):
    rows = [list(range(11)), [7], []]
    assert values(spark, rows, "array<int>", arrays.every_nth) == [row[1::3] for row in rows]


def test_sentences_and_words(spark):
    rows = ["One, two!  Three?\nFour v1.5 end.", "", None, "No end"]
    assert values(spark, rows, "string", text.sentences) == [["One, two!", "Three?", "Four v1.5 end."], [""], ["nan"], ["No end"]]
    assert values(spark, ["One, two!"], "string", text.sentence_words) == [["one", ",", "two", "!"]]
    assert values(spark, ["Ærø, 2 Wörter"], "string", text.words) == [["ærø", "2", "wörter"]]
    assert values(spark, ["A\nB"], "string", text.normalise_text) == ["a b"]
