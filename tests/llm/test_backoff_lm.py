import math
import re
from collections import Counter

import pytest

from gradeloom.llm.backoff_lm import score_texts


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def brute(rows, order, strength):
    """An automaton with explicit states, arcs and failure arcs, walked token by token."""
    counts = Counter()
    for _, text, training in rows:
        tokens = tokens_of(text) if training else []
        for n in range(1, order + 1):
            counts.update(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in counts)

    def root(word):
        return (counts[word,] + 0.1) / (total + 0.1 * (types + 1))

    def weight(state, word):
        if not state:
            return root(word)
        lower = weight(state[1:], word)
        c = counts[state]
        if (*state, word) in counts:
            return (counts[(*state, word)] + strength * lower) / (c + strength)
        return strength / (c + strength) * lower

    result = []
    for doc_id, text, _ in rows:
        tokens, state, score, base = tokens_of(text), (), 0.0, 0.0
        for word in tokens:
            score += math.log10(weight(state, word))
            base += math.log10(root(word))
            state = (*state, word)[-(order - 1) :] if order > 1 else ()
            while state and state not in counts:
                state = state[1:]
        result.append((doc_id, len(tokens), sum(counts[t,] > 0 for t in tokens), total, base, score))
    return result


ROWS = [
    (1, "The cat sat on the mat.", True),
    (2, "the cat  SAT on\nthe hat é É", True),
    (3, "the cat sat under an unknown mat.", False),
    (4, None, True),
    (5, "", False),
    (6, "a " * 3000 + "b", True),
    (6, "a " * 3000 + "b", True),
    (7, "a b a b the cat", None),
    (None, "sat on the cat sat", False),
]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force_automaton(table, order, monkeypatch):
    monkeypatch.setattr("gradeloom.llm.backoff_lm.LM_BLOCK_BYTES", 50)
    got = score_texts(table(ROWS, "doc_id long, text string, training boolean"), "training", order=order, strength=2.0)
    assert got.columns == ["doc_id", "text", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = sorted(((r.doc_id, *r[3:]) for r in got.collect()), key=repr)
    for row, expected in zip(found, sorted(brute(ROWS, order, 2.0), key=repr), strict=True):
        assert row[:4] == expected[:4]
        assert row[4:] == pytest.approx(expected[4:], rel=1e-9)


def test_totals_come_back_by_place_also_if_a_scan_cuts_a_block(spark, table):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        got = score_texts(table(ROWS, "doc_id long, text string, training boolean"), "training", strength=2.0)
        assert "places#" in got._jdf.queryExecution().toString()
        found = sorted(((r.doc_id, *r[3:]) for r in got.collect()), key=repr)
    finally:
        spark.conf.set(name, before)
    for row, expected in zip(found, sorted(brute(ROWS, 2, 2.0), key=repr), strict=True):
        assert row[:4] == expected[:4]
        assert row[4:] == pytest.approx(expected[4:], rel=1e-9)


def test_next_token_probabilities_sum_to_one(table):
    rows = [(1, "x y x z x y", True), (2, "x x", True)]
    rows += [(10 + i, f"x {w}", False) for i, w in enumerate(["x", "y", "z", "never"])] + [(20, "x", False)]
    got = {r.doc_id: r for r in score_texts(table(rows, "doc_id long, text string, training boolean"), "training").collect()}
    after_x = brute([*rows], 2, 4.0)
    assert [got[r[0]].score for r in after_x] == pytest.approx([r[5] for r in after_x], rel=1e-9)


def test_no_training_rows_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, training boolean, score string, n_tokens string"
    assert score_texts(spark.createDataFrame([], schema), "training").count() == 0
    row = score_texts(spark.createDataFrame([(1, "a b", False, "x", "y")], schema), "training").first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
