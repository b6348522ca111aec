import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.text import words
from gradeloom.operators import classifier, metrics, tokens, word_vectors
from gradeloom.operators.sampling import concat
from gradeloom.operators.word_vectors import STEPS, count_neighbours, train_word_vectors
from gradeloom.plans import word_similarity as word_similarity_plan
from gradeloom.plans.single_run import single_run
from gradeloom.plans.training_sets import training_sets
from gradeloom.plans.word_similarity import word_similarity
from gradeloom.sources import run_store

@pytest.fixture(scope="module")
def texts(spark):
    """Texts whose words tell the label."""
    word = F.when(F.col("id") % 3 == 0, "bad awful").otherwise("good fine")
    return spark.range(120).select(
        F.col("id").alias("row_idx"),
        F.col("id").alias("par_id"),
        F.concat_ws(" ", word, F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("text"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
    )


@pytest.fixture(scope="module")
def sides(texts):
    return texts.filter("par_id < 90"), texts.filter("par_id >= 90")


def test_vocab_orders_by_count_then_word(spark):
    df = spark.createDataFrame([("b a b",), ("A c, ü",), (None,)], "text string")
    got = [tuple(r) for r in tokens.build_vocab(df).orderBy("id").collect()]
    assert got == [("a", 2, 2), ("b", 2, 3), ("c", 1, 4), ("nan", 1, 5), ("ü", 1, 6)]
    assert [r["token"] for r in tokens.build_vocab(df, min_count=2, max_size=1).collect()] == ["a"]
    for size in range(1, 7):
        assert [tuple(r) for r in tokens.build_vocab(df, max_size=size).orderBy("id").collect()] == got[:size]


def test_encoding_cuts_and_pads(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "b unknown"), (3, "!!"), (4, None)], "par_id int, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("d", 5), ("nan", 9)], "token string, id int")
    wanted = {1: ([2, 3, 4, 5], [1] * 4), 2: ([3, 1, 0, 0], [1, 1, 0, 0]), 3: ([0] * 4, [0] * 4), 4: ([9, 0, 0, 0], [1, 0, 0, 0])}
    rows = tokens.encode_tokens(df, vocab, max_length=4).collect()
    assert {r["par_id"]: (r["input_ids"], r["attention_mask"]) for r in rows} == wanted


def test_begin_and_end_count_towards_the_length(spark):
    df = spark.createDataFrame([("a b c",), ("b",), ("!",)], "text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "token string, id int")
    rows = tokens.encode_tokens(df, vocab, max_length=4, begin=2, end=3).collect()
    assert {r["text"]: r["input_ids"] for r in rows} == {"a b c": [2, 4, 5, 3], "b": [2, 5, 3, 0], "!": [2, 3, 0, 0]}
    with pytest.raises(ValueError, match="no room"):
        tokens.encode_tokens(df, vocab, max_length=2, begin=2, end=3)


def test_encoding_does_not_mix_rows_that_share_an_id(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c"), (1, "c b"), (None, "b"), (None, "a")], "par_id int, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    wanted = {"a b c": [2, 3, 4, 0], "c b": [4, 3, 0, 0], "b": [3, 0, 0, 0], "a": [2, 0, 0, 0]}
    for head in (20_000, 1):
        monkeypatch.setattr(tokens, "HEAD", head)
        rows = tokens.encode_tokens(df, vocab, max_length=4).collect()
        assert {r["text"]: r["input_ids"] for r in rows} == wanted and len(rows) == 4


def test_paraphrases_that_fail_are_marked(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, None)], "par_id bigint, text string")

    def paraphrase(batch):
        if (batch == "boom").any():
            raise RuntimeError("no translation")
        return batch.str.upper()

    got = {r["par_id"]: (r["text"], r["origin"], r["copy_no"], r["error"]) for r in tokens.augment_text(df, paraphrase, "zh").collect()}
    assert got[1] == ("OK", "aug", "zh", None)
    assert got[2] == (None, "aug", "zh", "RuntimeError: no translation")


@pytest.mark.parametrize("column, size", [("_words", 4), ("text", 5)])
def test_batches_are_worked_on_in_parts_of_bounded_size(column, size):
    words = [["a"] * 3, [], None, ["b"] * 9, ["c"], ["d", None]]
    batch = pa.record_batch({"_words": pa.array(words, pa.list_(pa.string())), "text": pa.array(["abc", "", None, "x" * 9, "é", "y"])})
    parts = list(tokens.parts_of(iter([batch, batch.slice(0, 0)]), column, size))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    for part in parts:
        lengths = [len(x.encode() if column == "text" else x) for x in part.column(column).to_pylist() if x]
        assert sum(lengths[1:]) <= size


def counted_neighbours(sentences, window):
    counts = Counter()
    for sentence in sentences:
        for i, a in enumerate(sentence):
            for k, b in enumerate(sentence[i + 1 : i + 1 + window], 1):
                if a is not None and b is not None:
                    counts[tuple(sorted((a, b)))] += window + 1 - k
    return counts


SENTENCES = [["a", "b", "a", "c"], ["b", "b"], [], ["d"], ["a", None, "é", "a", "b", "c", "a"], ["a", "b", "c"] * 2000]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_neighbours_are_counted_by_distance(spark, window):
    df = spark.createDataFrame([(s,) for s in SENTENCES], "words array<string>").repartition(3)
    got = {(r["a"], r["b"]): r["n"] for r in count_neighbours(df, window).collect()}
    assert got == counted_neighbours(SENTENCES, window)


@pytest.mark.parametrize("at_once", [1, 2, 7, 100_000])
def test_neighbours_are_added_up_before_they_are_dealt_out(at_once):
    lists = [pa.array([*SENTENCES[:3], None, *SENTENCES[3:]], pa.list_(pa.string()))] * 2
    batches = list(word_vectors._counted(lists, 3, at_once))
    got, n_rows = Counter(), 0
    for row in pa.Table.from_batches(batches).to_pylist():
        got[row["a"], row["b"]] += row["n"]
        n_rows += 1
    assert got == counted_neighbours(SENTENCES * 2, 3)
    if at_once == 100_000:
        assert n_rows == len(got)


@pytest.mark.parametrize("keys", [1, 2, 7])
def test_pairs_of_a_task_are_added_up_in_parts(monkeypatch, keys):
    monkeypatch.setattr(word_vectors, "KEYS_AT_ONCE", keys)
    sentences = [*SENTENCES[:5], ["a", "b", "c"] * 9]
    (batch,) = word_vectors._counted([pa.array(sentences)], 3, 1000)
    rows = batch.to_pylist()
    wanted = counted_neighbours(sentences, 3)
    assert len(rows) == len(wanted) and {(r["a"], r["b"]): r["n"] for r in rows} == wanted


@pytest.mark.parametrize("head, buckets", [(1, 3), (3, 1), (4, 1024)])
def test_pairs_do_not_depend_on_which_words_are_frequent(spark, monkeypatch, head, buckets):
    monkeypatch.setattr(word_vectors, "HEAD", head)
    monkeypatch.setattr(word_vectors, "LEAST_BUCKETS", buckets)
    monkeypatch.setattr(word_vectors, "PAIRS_AT_ONCE", 50)
    df = spark.createDataFrame([(s,) for s in [*SENTENCES, ["", "x\ny", "é", ""], None]], "words array<string>").repartition(3)
    got = [(r["a"], r["b"], r["n"]) for r in count_neighbours(df).collect()]
    wanted = counted_neighbours([*SENTENCES, ["", "x\ny", "é", ""]], 5)
    assert len(got) == len(wanted) and {(a, b): n for a, b, n in got} == wanted


def test_pairs_are_dealt_out_as_few_bytes_and_not_word_by_word(spark):
    words = [F.md5(F.floor(F.pow(F.rand(i), 3) * 3000).cast("string")) for i in range(20)]
    df = spark.range(0, 4000, 1, 2).select(F.array(*words).alias("words"))
    counts = count_neighbours(df)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(a" not in plan
    head = word_vectors._head(word_vectors._word_sums(df, 5), 1)
    parcels = word_vectors._pairs(df, 5, spark.sparkContext.broadcast(head), both=False)
    sent = parcels.selectExpr("sum(aggregate(parts, 0, (n, x) -> n + octet_length(x)))").first()[0]
    # Each pair once per task at most; the words alone have 64 bytes a pair.
    assert sent < 8 * counts.count()


@pytest.mark.parametrize("values", [[], [0], [5, -3, 2**40, -(2**40)], list(range(-300, 300))])
def test_packed_numbers_and_words_come_back(values):
    assert word_vectors._unpacked(word_vectors._packed(np.array(values, np.int64))).tolist() == values
    words = pa.array([str(x) * (x % 3) for x in values], pa.string())
    assert word_vectors._unpacked_words(*word_vectors._packed_words(words)).equals(words)


def test_word_vectors_equal_those_worked_out_by_hand(spark):
    df = spark.createDataFrame([(s,) for s in SENTENCES], "words array<string>")
    sums, directed = Counter(), Counter()
    for (a, b), n in counted_neighbours(SENTENCES, 3).items():
        directed[a, b] += n
        directed[b, a] += n
    for (a, _), n in directed.items():
        sums[a] += n
    wanted = {word: [0.0] * 8 for s in SENTENCES for word in s if word}
    for (a, b), n in directed.items():
        ratio = n * sum(sums.values()) / (sums[a] * sums[b])
        digest = hashlib.md5(b.encode()).hexdigest()
        if ratio > 1:
            sign = 1 if int(digest[8], 16) < 8 else -1
            wanted[a][int(digest[:8], 16) % 8] += sign * round(math.log(ratio) * STEPS) / STEPS
    for rows in (df, df.repartition(5)):
        got = {r["word"]: r["vector"] for r in train_word_vectors(rows, size=8, window=3).collect()}
        assert got == wanted
    frequent = train_word_vectors(df, size=8, window=3, min_count=5).collect()
    assert {r["word"] for r in frequent} == {"a", "b", "c"}


@pytest.mark.parametrize("head", [1, 4])
def test_vectors_do_not_depend_on_which_words_are_looked_up_in_place(spark, monkeypatch, head):
    rows = spark.createDataFrame([(s,) for s in SENTENCES], "words array<string>")
    wanted = {tuple(r) for r in train_word_vectors(rows, size=8).selectExpr("word", "n", "string(vector)").collect()}
    monkeypatch.setattr(word_vectors, "HEAD", head)
    assert {tuple(r) for r in train_word_vectors(rows, size=8).selectExpr("word", "n", "string(vector)").collect()} == wanted


@pytest.mark.parametrize("head, buckets", [(0, 1), (1, 2), (3, 1024), (4, 1)])
@pytest.mark.parametrize("min_count", [1, 3])
def test_vectors_meet_in_buckets_only(spark, monkeypatch, head, buckets, min_count):
    sentences = [*SENTENCES, ["p", "q", "r", "p"], ["q", "s", "t", "é"], ["p"], ["q", None, "r", "é"], ["alone"]]
    counts = Counter(w for s in sentences for w in s if w)
    kept = [[w if w and counts[w] >= min_count else None for w in s] for s in sentences]
    directed, sums = Counter(), Counter()
    for (a, b), n in counted_neighbours(kept, 3).items():
        directed[a, b] += n
        directed[b, a] += n
    for (a, _), n in directed.items():
        sums[a] += n
    wanted = {w: [0.0] * 8 for w, n in counts.items() if n >= min_count}
    for (a, b), n in directed.items():
        ratio = n * sum(sums.values()) / (sums[a] * sums[b])
        digest = hashlib.md5(b.encode()).hexdigest()
        if ratio > 1:
            wanted[a][int(digest[:8], 16) % 8] += (1 if int(digest[8], 16) < 8 else -1) * round(math.log(ratio) * STEPS) / STEPS
    monkeypatch.setattr(word_vectors, "HEAD", head)
    monkeypatch.setattr(word_vectors, "LEAST_BUCKETS", buckets)
    df = spark.createDataFrame([(s,) for s in sentences], "words array<string>").repartition(3)
    vectors = train_word_vectors(df, size=8, window=3, min_count=min_count)
    got = {r["word"]: (r["n"], r["vector"]) for r in vectors.collect()}
    assert got == {w: (counts[w], v) for w, v in wanted.items()}
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(bucket") > 0


@pytest.mark.parametrize("at_once", [1, 8, 1 << 20])
@pytest.mark.parametrize("n_head", [0, 1, 3])
def test_entries_do_not_depend_on_how_many_a_task_holds(monkeypatch, at_once, n_head):
    totals = Counter()
    for (a, b), n in counted_neighbours(SENTENCES, 3).items():
        totals[a] += n
        totals[b] += n
    spoken = sorted({w for s in SENTENCES for w in s if w})
    marks = np.array([1, -3, 2, 3, -1])
    each = [spoken, [1] * 5, [totals[w] for w in spoken], marks]
    head = word_vectors.Head(pa.array(spoken[:n_head], pa.string()), np.array(each[2][:n_head], np.int64), marks[:n_head], 1, 3)
    described = pa.record_batch([pa.array(x) for x in each], names=["word", "n", "total", "mark"])

    def met(rows):
        return iter([word_vectors._parcels([row]) for row in sorted(rows, key=lambda row: row[0])])

    def vectors():
        counted = word_vectors._counted([pa.array(SENTENCES)], 3, 7)
        pairs = [row for some in counted for row in word_vectors._dealt(some, head, True)]
        words = list(word_vectors._word_parcels([described], head))
        sent = pa.Table.from_batches(word_vectors._weighed(met([*pairs, *words]), head, 3, sum(totals.values()))).to_pylist()
        entries = [(r["bucket"], r["kind"], r["parts"]) for r in sent]
        found = word_vectors._filled(met([*entries, *words]), head, 3, sum(totals.values()))
        return {r["word"]: r["vector"] for r in pa.Table.from_batches(found).to_pylist()}

    wanted = vectors()
    assert sorted(wanted) == spoken and any(map(any, wanted.values()))
    monkeypatch.setattr(word_vectors, "ENTRIES_AT_ONCE", at_once)
    monkeypatch.setattr(word_vectors, "ROWS_AT_ONCE", at_once)
    assert vectors() == wanted


def test_no_vocabulary_and_no_sentence_is_too_large(spark):
    many = spark.range(30_000).select(F.array(F.concat(F.lit("w"), "id"), F.lit("the")).alias("words"))
    assert train_word_vectors(many, size=4).count() == 30_001
    empty = spark.createDataFrame([], "words array<string>")
    assert train_word_vectors(empty).count() == 0


def test_word_similarity(spark, texts):
    pairs = spark.createDataFrame([("good", "fine"), ("bad", "bad")], "a string, b string")
    got = {r["a"]: r["similarity"] for r in word_similarity(texts, pairs, size=8).collect()}
    assert got["bad"] == pytest.approx(1) and -1 <= got["good"] <= 1


@pytest.mark.parametrize("few", [0, 500_000])
def test_only_vectors_that_are_compared_are_dealt_out(spark, monkeypatch, few):
    monkeypatch.setattr(word_similarity_plan, "ASKED", few)
    texts = spark.createDataFrame([(1, "p q r s. q r t."), (2, "s t p."), (3, None)], "par_id long, text string")
    pairs = spark.createDataFrame([("p", "q"), ("t", "q"), ("p", "q")], "a string, b string")
    found = word_similarity(texts, pairs, size=8)
    vectors = {r["word"]: np.array(r["vector"]) for r in train_word_vectors(tokens.sentences_of_words(texts, "par_id"), size=8).collect()}
    got = sorted((r["a"], r["b"], r["similarity"]) for r in found.collect())
    alike = lambda a, b: vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
    assert got == [(a, b, pytest.approx(alike(a, b))) for a, b in (("p", "q"), ("p", "q"), ("t", "q"))]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="no vector for other"):
        word_similarity(texts, spark.createDataFrame([("other", "q")], "a string, b string"), size=8).collect()


def by_hand(train, epochs, rate, batch_size):
    """Weights after each epoch."""
    rows = [({"": 1.0} | {w: math.sqrt(n / len(t.split())) for w, n in Counter(t.split()).items()}, y) for t, y in train]
    n = Counter(w for features, _ in rows for w in features)
    share = sum(y for _, y in rows) / len(rows)
    weights, found = dict.fromkeys(n, 0.0) | {"": math.log(share / (1 - share))}, []
    rarity = {w: (math.log(len(rows) / n[w]) / math.log(len(rows))) ** 2 for w in n}
    for _ in range(epochs):
        slopes = Counter()
        for features, y in rows:
            error = 1 / (1 + math.exp(-sum(weights[w] * x for w, x in features.items()))) - y
            for w, x in features.items():
                slopes[w] += error * x
        weights = {w: weights[w] - rate * classifier.STEP * rarity[w] * slopes[w] / max(n[w], batch_size) for w in n}
        found.append(weights)
    return found


def test_training_equals_plain_gradient_steps(sides):
    train, valid = sides
    rows = [(r["text"], r["label"]) for r in train.collect()]
    for rate, batch_size in ((2e-5, 6), (1e-5, 50)):
        expected = by_hand(rows, 3, rate, batch_size)
        model, log = classifier.train_text_classifier(train, valid, epochs=3, rate=rate, batch_size=batch_size)
        best = log.orderBy("eval_loss", "epoch").first()["epoch"]
        got = {r["feature"]: r["weight"] for r in model.weights.collect()}
        assert got == pytest.approx(expected[best - 1], abs=1e-6)


def test_an_epoch_starts_from_the_last_weights(sides, monkeypatch):
    """N epochs are N passes, each from what the one before has learnt."""
    begins = []
    learn = classifier._learn

    def noted(rows, entries, weights, *rest):
        begins.append(weights)
        return learn(rows, entries, weights, *rest)

    monkeypatch.setattr(classifier, "_learn", noted)
    train, valid = sides
    classifier.train_text_classifier(train, valid, epochs=4)
    assert len(begins) == 4 and begins[0] is None and all(w is not None for w in begins[1:])
    begins.clear()
    trials = [classifier.Trial(f"r{i}", 1e-5 * (i + 1), 6, 2 + i % 2) for i in range(5)]
    classifier.search_hyperparameters(train, valid, valid, trials=trials, rungs=())
    assert len(begins) == 3


def test_training_is_repeatable_and_keeps_the_best_epoch(sides):
    train, valid = sides
    model, log = classifier.train_text_classifier(train, valid, epochs=3)
    again, other = classifier.train_text_classifier(train.repartition(3), valid, epochs=3)
    first, second = log.orderBy("epoch").collect(), other.orderBy("epoch").collect()
    assert [r["epoch"] for r in first] == [1, 2, 3]
    for a, b in zip(first, second):
        assert a["eval_loss"] == pytest.approx(b["eval_loss"], rel=1e-6) and a["eval_f1"] == b["eval_f1"]
    scored = metrics.evaluate_scores(classifier.score(model, valid)).head()
    best = min(first, key=lambda r: r["eval_loss"])
    assert scored["f1_score"] == best["eval_f1"] == 1.0


def test_scores_and_loss_equal_those_worked_out_by_hand(sides):
    train, valid = sides
    model, log = classifier.train_text_classifier(train, valid, epochs=1)
    weights = {r["feature"]: r["weight"] for r in model.weights.collect()}
    losses = []
    for row in classifier.score(model, valid).collect():
        words = Counter(row["text"].split())
        margin = weights[""] + sum(weights.get(w, 0) * math.sqrt(n / words.total()) for w, n in words.items())
        assert row["logits"] == pytest.approx([-margin / 2, margin / 2]) and row["prediction"] == int(margin > 0)
        losses.append(np.log1p(np.exp(-margin if row["label"] else margin)))
    assert log.head()["eval_loss"] == pytest.approx(np.mean(losses))


def test_odd_texts_are_scored(spark, sides):
    model, _ = classifier.train_text_classifier(*sides, epochs=1)
    weights = {r["feature"]: r["weight"] for r in model.weights.collect()}
    odd = [(None, "x"), ("", "y"), ("unknown words", None), ("bad " * 30_000, "z"), ("BAD", "w"), ("BAD", "w")]
    df = spark.createDataFrame(odd, "text string, row string")
    got = [(r["text"], r["row"], r["logits"][1] - r["logits"][0]) for r in classifier.score(model, df).collect()]
    said = {text: margin for text, _, margin in got}
    assert len(got) == 6 and {r for _, r, _ in got} == {"x", "y", None, "z", "w"}
    assert said[""] == said["unknown words"] == said[None] == pytest.approx(weights[""])
    assert said["BAD"] == said["bad " * 30_000] == pytest.approx(weights[""] + weights["bad"])
    assert classifier.score(model, df.limit(0)).count() == 0


def test_frequent_and_rare_features_give_the_same_scores(sides, monkeypatch):
    model, _ = classifier.train_text_classifier(*sides, epochs=1)
    found = []
    for head in (1, 4, 4096):
        monkeypatch.setattr(classifier, "HEAD", head)
        found.append({r["row_idx"]: r["logits"] for r in classifier.score(model, sides[1]).collect()})
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("head", [1, 4, 200_000])
def test_rare_and_frequent_features_learn_the_same(spark, monkeypatch, head):
    """Unlabelled rows count for the sizes of features only; a batch is worked on in parts."""
    monkeypatch.setattr(classifier, "HEAD", head)
    monkeypatch.setattr(classifier, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(classifier, "ENTRIES_AT_ONCE", 3)
    rows = [(f"same {'bad bad' if i % 3 else 'good'} w{i % 11} only{i}", int(i % 3 > 0)) for i in range(40)] + [("", 1)]
    train = spark.createDataFrame(rows, "text string, label int").repartition(3)
    model, _ = classifier.train_text_classifier(train, train, epochs=2)
    got = {r["feature"]: (r["n"], r["weight"]) for r in model.weights.collect()}
    assert {w: weight for w, (_, weight) in got.items()} == pytest.approx(by_hand(rows, 2, classifier.DEFAULT_RATE, 6)[1], abs=1e-6)
    assert got[""][0] == 41 and got["same"][0] == 40 and got["only3"][0] == 1
    odd = spark.createDataFrame([("same only5", None), ("never", None)], "text string, label int")
    mixed, _ = classifier.train_text_classifier(concat(train, odd), train, epochs=2)
    weights = {r["feature"]: (r["n"], r["weight"]) for r in mixed.weights.collect()}
    assert weights["never"] == (1, None) and weights["only5"][0] == 2 and weights["same"][0] == 41
    said = {r["text"]: r["logits"][1] for r in classifier.score(mixed, odd).collect()}
    assert said["never"] == pytest.approx(weights[""][1] / 2)


def test_epochs_and_scores_take_no_text_apart_twice(sides, monkeypatch):
    """Entries stay in their rows: only sums by feature are exchanged, and scores of known features need no exchange."""
    train, valid = sides
    plans = []
    stage = classifier.stage

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, name)

    monkeypatch.setattr(classifier, "stage", noted)
    model, _ = classifier.train_text_classifier(train, valid, epochs=2)
    learnt = [plan for name, plan in plans if name == "weights"]
    assert len(learnt) == 3 and not any("Generate " in plan for plan in learnt)
    plan = classifier.score(model, valid)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate " not in plan and plan.count("ArrowEvalPython ") == 1


def test_a_search_exchanges_sums_by_feature_only(sides, monkeypatch):
    train, valid = sides
    plans = []
    stage = classifier.stage

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, name)

    monkeypatch.setattr(classifier, "stage", noted)
    trials = [classifier.Trial(f"r{i}", 1e-5 * (i + 1), 6, 2) for i in range(3)]
    classifier.search_hyperparameters(train, valid, valid, trials=trials, rungs=())
    learnt = [plan for name, plan in plans if name == "weights"]
    assert len(learnt) == 3 and not any("Generate " in plan for plan in learnt)


def test_a_single_run_scores_its_rows_without_an_exchange(sides, monkeypatch, tmp_path):
    from gradeloom.plans import single_run as plan_of

    train, valid = sides
    plans = []
    stage = plan_of.stage

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(plan_of, "stage", noted)
    run = single_run(train, valid, valid, valid.select("row_idx", "text"), str(tmp_path), "r", min_f1=-1.0, epochs=1)
    assert run.attempt is not None and len(plans) == 1 and "Exchange" not in plans[0]


@pytest.mark.parametrize("head", [1, 200_000])
def test_models_of_no_rows(sides, monkeypatch, head):
    monkeypatch.setattr(classifier, "HEAD", head)
    train, valid = sides
    model, log = classifier.train_text_classifier(train.limit(0), valid, epochs=1)
    assert model.weights.count() == 0 and log.first()["eval_loss"] == pytest.approx(math.log(2))
    assert {tuple(r["logits"]) for r in classifier.score(model, valid).collect()} == {(0.0, 0.0)}
    _, log = classifier.train_text_classifier(train, valid.limit(0), epochs=1)
    assert math.isnan(log.first()["eval_loss"]) and log.first()["eval_f1"] == 0


def test_saved_models_score_the_same(spark, sides, tmp_path):
    train, valid = sides
    model, _ = classifier.train_text_classifier(train, valid, epochs=1)
    classifier.save_model(model, str(tmp_path / "model"))
    loaded = classifier.load_model(spark, str(tmp_path / "model"))
    a, b = (classifier.score(m, valid).orderBy("row_idx").collect() for m in (model, loaded))
    assert a == b and a[0].asDict().keys() == {"row_idx", "par_id", "text", "label", "logits", "prediction"}


def test_search_keeps_good_runs(spark, sides, tmp_path):
    train, valid = sides
    output = str(tmp_path / "search")
    runs = classifier.search_hyperparameters(train, valid, valid, final=valid.drop("label"), trials=2, output=output)
    table = runs.collect()
    assert sorted((r["run_id"], r["split"]) for r in table) == [(f"run-{i}", s) for i in (0, 1) for s in ("dev", "valid")]
    assert all(1e-5 <= r["learning_rate"] <= 4e-5 and r["batch_size"] == 6 and r["epochs"] in (2, 3, 4, 6) for r in table)
    stored = run_store.read_run_scores(spark, output)
    assert stored.groupBy("run_id", "split").count().filter("count = 30").count() == 4
    labelled = stored.filter("split = 'valid'")
    assert labelled.filter("label IS NULL").count() == 0 and stored.filter("split = 'final' AND label IS NOT NULL").count() == 0
    chosen = metrics.best_run(runs, split="valid").head()
    best = classifier.load_best(spark.newSession(), output)
    assert metrics.evaluate_scores(classifier.score(best, valid)).head()["f1_score"] == chosen["f1"]
    with pytest.raises(ValueError, match="no run passed"):
        classifier.load_best(spark, str(tmp_path / "nothing"))


def test_all_trials_of_a_search_equal_single_runs(sides):
    train, valid = sides
    trials = [classifier.Trial("a", 1e-6, 6, 2), classifier.Trial("b", 4e-5, 6, 3), classifier.Trial("c", 4e-6, 200, 3)]
    rows = classifier.search_hyperparameters(train, valid, valid, trials=trials, rungs=()).filter("split = 'valid'").collect()
    found = {r["run_id"]: (r["f1"], r["accuracy"], r["epochs_run"]) for r in rows}
    for t in trials:
        _, log = classifier.train_text_classifier(train, valid, t.epochs, t.learning_rate, t.batch_size)
        best = log.orderBy("eval_loss", "epoch").first()
        assert found[t.run_id] == (best["eval_f1"], best["eval_accuracy"], t.epochs)


def test_rate_and_batch_size_change_the_result(spark):
    # Rare words decide, so that small steps do not get beyond the majority.
    rows = [(i, f"common text {'bad' if i % 4 == 0 else 'good'} w{i}", int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "par_id long, text string, label int")
    train, valid = df.filter("par_id < 80"), df.filter("par_id >= 80")
    trials = [classifier.Trial(f"{r}-{b}", r, b, 3) for r in (1e-6, 4e-5) for b in (6, 500)]
    found = classifier.search_hyperparameters(train, valid, valid, trials=trials, rungs=()).filter("split = 'valid'")
    f1 = {r["run_id"]: r["f1"] for r in found.collect()}
    assert f1["4e-05-6"] > f1["1e-06-6"]
    logs = [classifier.train_text_classifier(train, valid, 1, 2e-5, b)[1].first()["eval_loss"] for b in (6, 500)]
    assert logs[0] != logs[1]


def test_trials_below_the_median_stop(spark):
    rows = [(i, f"common text {'bad' if i % 4 == 0 else 'good'} w{i}", int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "par_id long, text string, label int")
    trials = [classifier.Trial(f"r{i}", rate, 6, 4) for i, rate in enumerate((1e-7, 4e-5, 3e-5))]
    runs = classifier.search_hyperparameters(df.filter("par_id < 80"), df.filter("par_id >= 80"), df, trials=trials, rungs=(1, 2))
    reached = {r["run_id"]: r["epochs_run"] for r in runs.collect()}
    assert reached["r0"] < 4 and reached["r1"] == 4


def test_broken_and_repeated_commits(spark, sides, tmp_path):
    path = str(tmp_path / "runs")
    scored = sides[1].select("row_idx", "label", F.array(F.lit(0.0), F.lit(1.0)).alias("logits"))
    with pytest.raises(Exception, match="broken"):
        broken = scored.withColumn("label", F.raise_error(F.lit("broken")).cast("int"))
        run_store.commit_run(path, "a", {"valid": scored, "final": broken}, {"f1": 1.0}, {})
    assert run_store.read_runs(spark, path).count() == 0 and run_store.read_run_scores(spark, path).count() == 0
    first = run_store.commit_run(path, "a", {"valid": scored}, {"f1": 0.25}, {"epochs": 1})
    run_store.commit_run(path, "b", {"valid": scored.limit(3)}, {"f1": 0.5}, {})
    with pytest.raises(Exception, match="broken"):
        run_store.commit_run(path, "a", {"valid": broken}, {"f1": 1.0}, {})
    assert [r["attempt"] for r in run_store.read_runs(spark, path).filter("run_id = 'a'").collect()] == [first]
    run_store.commit_run(path, "a", {"valid": scored.limit(7), "final": scored}, {"f1": 0.75}, {"epochs": 2})
    kept = run_store.read_runs(spark, path).filter("run_id = 'a'").first()
    assert kept["metrics"] == {"f1": 0.75} and kept["settings"] == {"epochs": "2"} and kept["splits"] == ["valid", "final"]
    counts = {(r["run_id"], r["split"]): r["count"] for r in run_store.read_run_scores(spark, path).groupBy("run_id", "split").count().collect()}
    assert counts == {("a", "valid"): 7, ("a", "final"): 30, ("b", "valid"): 3}
    assert run_store.read_run_scores(spark, path, "a", "final").count() == 30


def test_single_run_keeps_only_good_ones(spark, sides, tmp_path):
    train, valid = sides
    final = valid.select("row_idx", "text")
    run = single_run(train, valid, valid, final, str(tmp_path), "r", min_f1=1.0, epochs=2)
    assert run.attempt is None and run_store.read_runs(spark, str(tmp_path)).count() == 0
    run = single_run(train, valid, valid, final, str(tmp_path), "r", epochs=2, rate=2e-5)
    assert run.metrics.first()["f1_score"] == 1.0
    assert [tuple(r) for r in run.matrix.collect()] == [(0, 20, 0), (1, 0, 10)]
    kept = run_store.read_runs(spark, str(tmp_path)).first()
    assert (kept["attempt"], kept["metrics"]["dev_f1"], kept["settings"]) == (run.attempt, 1.0, {"epochs": "2", "rate": "2e-05"})


def test_no_text_is_sent_twice(spark, tmp_path):
    sent = spark.sparkContext.accumulator(0)
    rows = [(i, None if i % 10 == 9 else f"text {i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "par_id long, text string").repartition(4)

    def paraphrase(batch):
        sent.add(len(batch))
        if (batch == "text 3").any():
            raise RuntimeError("no answer")
        return batch + "!"

    memo = str(tmp_path / "memo")
    first = tokens.augment_text_once(df, paraphrase, "fr", memo, parts=3).collect()
    calls = sent.value
    assert {(r["text"], r["error"]) for r in first if dict(rows)[r["par_id"]] is None} == {(None, None)}
    assert {r["error"] for r in first if dict(rows)[r["par_id"]] == "text 3"} == {"RuntimeError: no answer"}
    again = tokens.augment_text_once(df, lambda batch: [sent.add(len(batch)), batch + "?"][1], "fr", memo, parts=3).collect()
    # Only the text without an answer is sent again.
    assert sent.value == calls + 1
    said = {dict(rows)[r["par_id"]]: r["text"] for r in again}
    assert said == {None: None} | {f"text {i}": f"text {i}{'?' if i == 3 else '!'}" for i in range(7)}
    assert len(again) == 100 and {r["origin"] for r in again} == {"aug"} and {r["error"] for r in again} == {None}


def test_only_rare_words_are_exchanged(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").alias("par_id"), F.concat_ws(" ", F.lit("a b"), F.concat(F.lit("w"), "id")).alias("text"))
    vocab = tokens.build_vocab(df)
    for head, kinds in ((200_000, 0), (2, 4)):
        monkeypatch.setattr(tokens, "HEAD", head)
        encoded = tokens.encode_tokens(df, vocab, max_length=4)
        plan = encoded._jdf.queryExecution().executedPlan().toString()
        # Nothing is taken apart but the rare words.
        assert plan.count("Generate ") == plan.count("Generate inline(_rare") and ("Exchange" in plan) == bool(kinds)
        ids = {r["token"]: r["id"] for r in vocab.collect()}
        for row in encoded.collect():
            assert row["input_ids"] == [ids[w] for w in row["text"].split()] + [0]


def test_trials_are_drawn_from_the_seed():
    assert classifier.draw_trials(seed=1) == classifier.draw_trials(seed=1) != classifier.draw_trials(seed=2)
    assert len(classifier.draw_trials()) == 25 and {t.epochs for t in classifier.draw_trials()} == {2, 3, 4, 6}


def test_baseline_scorers(texts):
    never = classifier.evaluate_baseline(texts, classifier.constant_scorer(0)).head()
    always = classifier.evaluate_baseline(texts, classifier.constant_scorer(1)).head()
    guess = classifier.evaluate_baseline(texts, classifier.hash_scorer(["par_id"])).head()
    assert (never["tn"], never["fn"], always["tp"], always["fp"]) == (80, 40, 40, 80)
    assert 0.3 < guess["accuracy"] < 0.7
    own = classifier.evaluate_baseline(texts, lambda: lambda batch: np.column_stack([np.full(len(batch), 0.5), batch.str.contains("bad")])).head()
    assert (own["tp"], own["tn"], own["fp"], own["fn"]) == (40, 80, 0, 0)


def test_callers_scorer_is_loaded_once_per_task(texts):
    def load():
        calls = []

        def scorer(batch: pd.Series):
            calls.append(len(batch))
            return [[0.0, float(len(calls))]] * len(batch)

        return scorer

    rows = classifier.score_with(texts.coalesce(1), load).collect()
    assert {tuple(r["logits"]) for r in rows} == {(0.0, 1.0)} and {r["prediction"] for r in rows} == {1}


def test_training_sets_follow_the_ratios(spark, sf_dir):
    from checks import tables as t

    sets = training_sets(t.train_list(spark, sf_dir), t.corpus(spark, sf_dir), t.augmented(spark, sf_dir), 2, 1.5)
    counts = {(r["label"], r["origin"]): r["count"] for r in sets.rebalanced.groupBy("label", "origin").count().collect()}
    positives = counts[1, "orig"]
    assert counts[0, "orig"] == 2 * positives and counts[1, "aug"] == int(positives * 1.5 - positives)
    assert sets.train.join(sets.valid, "par_id").count() == 0


def test_repeated_corpus_ids_keep_their_texts(spark):
    corpus = spark.createDataFrame(
        [(i, f"text {i}", 4 if i < 10 else 0) for i in range(60)] + [(1, "other text 1", 4), (20, "other text 20", 0)],
        "par_id bigint, text string, label int",
    )
    listed = spark.range(60).select(F.col("id").alias("row_idx"), F.col("id").alias("par_id"), F.lit("x").alias("label"))
    copies = spark.createDataFrame([(1, "bt 1", "a.csv"), (2, "bt 2", "a.csv")], "par_id bigint, text string, copy_no string")
    once = corpus.filter("text not like 'other%'")
    # A copy of an id that is there twice is there twice as well.
    for rows, positives, added in ((once, 10, 2), (corpus, 11, 3)):
        sets = training_sets(listed, rows, copies, down_ratio=3, up_ratio=2)
        assert sets.rebalanced.count() == 4 * positives + added
        texts = [(r["par_id"], r["text"]) for r in concat(sets.train, sets.valid).collect()]
        assert set(texts) <= {(r["par_id"], r["text"]) for r in concat(rows, copies).collect()}
        assert len(texts) - len(set(texts)) <= added - 2
