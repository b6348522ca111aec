import math
import re
from collections import Counter

import pytest

from gradeloom.llm.quality_rules import (
    apply_cutoffs,
    binomial_tail,
    certified,
    choose_cutoffs,
    measure_quality,
)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


TEXTS = ["a b c a b c\nx\nx\n \n\nx ", None, "", " \n\v", "é ü ñ|## <a> 漢字", "one", "la " * 50_000, "a\rb\x0cc\n\rA!! B!!"]


def test_measures_equal_brute_force(table):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    got = measure_quality(table(rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got.count() == len(rows)
    for row in got.collect():
        assert tuple(row[n] for n in names) == brute(TEXTS[row.doc_id])


def test_tail_is_the_sum_of_the_binomial():
    for n, p in ((20, 0.1), (300, 0.02)):
        for k in range(0, n, 7):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert binomial_tail(5, 5, 0.5) == 1.0


def test_sequence_ends_at_the_first_cutoff_that_fails():
    assert certified([0, 0, 200, 0], 1000, 0.01, 0.01) == 2
    assert certified([0, 0], 100, 0.01, 0.01) == 0
    assert certified([0], 0, 0.5, 0.5) == 0


def test_cutoffs_reject_bad_texts_and_few_good_ones(spark):
    good = [("en", "plain words here", True)] * 3000
    bad = [("en", "bad### words### here###", False)] * 200
    few = [("xx", "bad### words###", False)] * 5 + [("xx", "fine words", True)] * 5
    df = spark.createDataFrame(good + bad + few + [(None, "a b", None)], "lang string, text string, good boolean")
    measured = measure_quality(df)
    cutoffs = choose_cutoffs(measured, "lang", "good")
    assert "symbols" in cutoffs["en"]
    assert cutoffs["xx"] == {}
    judged = apply_cutoffs(measured, "lang", cutoffs)
    rejected = {(r.lang, r.good): r["count"] for r in judged.filter("size(rejected_by) > 0").groupBy("lang", "good").count().collect()}
    assert rejected == {("en", False): 200}


def test_empty_table_and_clashing_names(spark):
    schema = "lang string, text string, n_words string, good boolean"
    empty = measure_quality(spark.createDataFrame([], schema))
    assert empty.count() == 0 and choose_cutoffs(empty, "lang", "good") == {}
    assert measure_quality(spark.createDataFrame([("en", "a b", "x", True)], schema)).first().n_words == 2
