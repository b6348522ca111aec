"""One query per operator over the whole test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession, functions as F

from checks import tables as t
from checks.tables import Query, rounded
from gradeloom.functions.arrays import argmax, cosine, every_nth
from gradeloom.functions.bins import bin_label, cut, length_bucket, range_label
from gradeloom.functions.labels import binarize, graded_label, graded_positive, prediction_as_string
from gradeloom.functions.text import normalise_text, text_length, text_or_nan, word_count
from gradeloom.operators import classifier, joins, metrics, sampling, tokens
from gradeloom.operators.previews import preview
from gradeloom.operators.row_index import with_row_index
from gradeloom.operators.word_vectors import count_neighbours, train_word_vectors
from gradeloom.plans.data_report import data_report
from gradeloom.plans.error_report import corpus_features, error_slices, evaluated_rows, gold_rows
from gradeloom.plans.label_files import write_label_files
from gradeloom.plans.single_run import single_run
from gradeloom.plans.training_sets import training_sets
from gradeloom.plans.word_similarity import word_similarity
from gradeloom.sources import lines, run_store, scores, tables
from gradeloom.staging import fresh_path, stage

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# Sources and sinks: write the stand-ins to the shared folder and read them back.


def _corpus_file(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "corpus.tsv")
    fields = ("par_id", "art_id", "keyword", "country_code", "text", "label")
    rows = t.corpus(spark, sf_dir).withColumn("text", t.one_line("text"))
    rows = rows.select("par_id", F.concat_ws("\t", *fields).alias("value"))
    preamble = spark.range(-2, 0).select(F.col("id").alias("par_id"), F.lit("about this corpus").alias("value"))
    preamble.unionByName(rows).orderBy("par_id").select("value").write.text(path)
    return path


@query
def a1_read_corpus(spark, sf_dir):
    return tables.read_corpus(spark, _corpus_file(spark, sf_dir))


@query
def a1_read_corpus_consume(spark, sf_dir):
    return tables.read_corpus(spark, _corpus_file(spark, sf_dir), header="consume")


@query
def a2_read_split_labels(spark, sf_dir):
    path = fresh_path(spark, "labels.csv")
    t.gold_list(spark, sf_dir).orderBy("par_id").write.option("header", True).csv(path)
    return tables.read_split_labels(spark, path)


@query
def a3_read_unlabelled(spark, sf_dir):
    path = fresh_path(spark, "unlabelled.tsv")
    rows = t.documents(spark, sf_dir).withColumn("text", t.one_line("text"))
    fields = ("par_id", F.lit("a"), "source", "lang", "text")
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return tables.read_unlabelled(spark, path)


@query
def a3_read_unlabelled_in_order(spark, sf_dir):
    path = fresh_path(spark, "unlabelled.tsv")
    rows = t.documents(spark, sf_dir).withColumn("text", t.one_line("text"))
    fields = ("par_id", F.lit("a"), "source", "lang", "text")
    rows.select("par_id", F.concat_ws("\t", *fields).alias("value")).orderBy("par_id").select("value").write.text(path)
    return tables.read_unlabelled(spark, path, positions=True)


@query
def a4_read_augmented(spark, sf_dir):
    path = fresh_path(spark, "augmented")
    copies = t.documents(spark, sf_dir).withColumn("label", F.col("source"))
    english, foreign = copies.filter(F.col("lang") == "en"), copies.filter(F.col("lang") != "en")
    tables.write_augmented(english.select("par_id", "label", "text"), path)
    tables.write_augmented(foreign.select("text", "par_id"), path, mode="append")
    return tables.read_augmented(spark, path).drop("copy_no")


@query
def a5_read_indexed_lines(spark, sf_dir):
    path = fresh_path(spark, "predictions.txt")
    t.evaluated(spark, sf_dir).orderBy("par_id").select("prediction").write.text(path)
    return lines.read_indexed_lines(spark, path)


@query
def a6_read_training_log(spark, sf_dir):
    path = fresh_path(spark, "logs.json")
    t.logs(spark, sf_dir).write.json(path)
    return scores.log_entries(scores.read_training_log(spark, path, multi_line=False), "run_id")


@query
def a6_read_training_log_arrays(spark, sf_dir):
    """Logs in files of one JSON array each, which goes over many lines."""
    path = fresh_path(spark, "logs")
    logs = t.logs(spark, sf_dir).select("run_id", F.to_json(F.struct("run_id", "log_history")).alias("log"))
    arrays = logs.groupBy((F.col("run_id") % 8).alias("part")).agg(F.array_join(F.collect_list("log"), ",\n").alias("logs"))
    arrays.select("part", F.concat(F.lit("[\n"), "logs", F.lit("\n]")).alias("value")).write.partitionBy("part").text(path)
    return scores.log_entries(scores.read_training_log(spark, path), "run_id")


@query
def a7_write_label_lines(spark, sf_dir):
    path = fresh_path(spark, "labels.txt")
    predicted = t.scores(spark, sf_dir).select("row_idx", argmax(F.col("logits")).alias("prediction"))
    lines.write_label_lines(predicted, path)
    return lines.read_indexed_lines(spark, path)


@query
def a8_write_augmented(spark, sf_dir):
    path = fresh_path(spark, "augmented")
    tables.write_augmented(t.augmented(spark, sf_dir).drop("copy_no"), path)
    return tables.read_augmented(spark, path).drop("copy_no")


@query
def a9_read_scores(spark, sf_dir):
    path = fresh_path(spark, "scores")
    scores.write_scores(t.scores(spark, sf_dir), path)
    read = scores.read_scores(spark, path)
    return read.select("run_id", "split", "row_idx", *[F.col("logits")[i].alias(f"logit_{i}") for i in (0, 1)])


# Columns.


@query
def b1_resolve_label_columns(spark, sf_dir):
    own = F.when(F.col("lang") != "fr", F.concat(F.lit("own "), "text"))
    split = t.documents(spark, sf_dir).select("par_id", F.col("source").alias("label"), own.alias("text"))
    return joins.resolve_label_columns(split, t.corpus(spark, sf_dir), keep_keyword=True)


@query
def b2_binarize(spark, sf_dir):
    merged = joins.resolve_label_columns(t.all_list(spark, sf_dir), t.corpus(spark, sf_dir))
    return merged.select("par_id", binarize(F.col("label")).alias("label"))


@query
def b3_graded_label(spark, sf_dir):
    return t.corpus(spark, sf_dir).select("par_id", graded_label(F.col("label")).alias("label"))


@query
def b4_filter_class(spark, sf_dir):
    return sampling.filter_class(t.evaluated(spark, sf_dir), 1).select("par_id", "keyword", "label")


@query
def b5_text_length(spark, sf_dir):
    return t.documents(spark, sf_dir).select("par_id", text_length(F.col("text")).alias("text_length"))


@query
def b6_word_count(spark, sf_dir):
    return t.documents(spark, sf_dir).select("par_id", word_count(F.col("text")).alias("word_count"))


@query
def b7_length_bucket(spark, sf_dir):
    return t.documents(spark, sf_dir).select("par_id", length_bucket(text_length(F.col("text"))).alias("bucket"))


@query
def b8_cut(spark, sf_dir):
    binned = t.documents(spark, sf_dir).select("par_id", cut(text_length(F.col("text"))).alias("bin"))
    return binned.select("par_id", "bin.bin_left", "bin.bin_right")


@query
def b9_bin_label(spark, sf_dir):
    length = text_length(F.col("text"))
    binned = t.documents(spark, sf_dir).select(length.alias("n"), cut(length).alias("bin"))
    label = bin_label(F.col("bin.bin_left"), F.col("bin.bin_right"))
    return binned.groupBy(label.alias("bin")).agg(range_label(F.min("n"), F.max("n")).alias("observed"))


@query
def b10_graded_positive(spark, sf_dir):
    return t.corpus(spark, sf_dir).select("par_id", graded_positive(F.col("label"), 2).alias("positive"))


@query
def b11_text_or_nan(spark, sf_dir):
    merged = joins.resolve_label_columns(t.all_list(spark, sf_dir), t.corpus(spark, sf_dir))
    return merged.select("par_id", text_or_nan(F.col("text")).alias("text"))


@query
def b12_argmax(spark, sf_dir):
    return t.load(spark, sf_dir, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("class"))


@query
def b13_every_nth(spark, sf_dir):
    vectors = t.load(spark, sf_dir, "embeddings")
    chosen = vectors.select("vec_id", F.posexplode(every_nth(F.col("embedding"))).alias("pos", "value"))
    return chosen.withColumn("value", F.col("value").cast("double"))


@query
def b14_log_series(spark, sf_dir):
    return scores.log_series(t.logs(spark, sf_dir), "run_id")


@query
def b15_normalise_text(spark, sf_dir):
    return t.documents(spark, sf_dir).select("par_id", normalise_text(F.col("text")).alias("text"))


@query
def b16_preview(spark, sf_dir):
    rows = t.evaluated(spark, sf_dir).withColumnRenamed("par_id", "row_idx")
    return preview(rows.filter(F.col("graded") == 2).select("row_idx", "keyword", "prediction"))


@query
def b17_prediction_as_string(spark, sf_dir):
    said = prediction_as_string(t.prediction())
    return t.corpus(spark, sf_dir).select("par_id", said.alias("prediction"))


# Joins.


@query
def c1_merge_with_labels(spark, sf_dir):
    return joins.merge_with_labels(t.all_list(spark, sf_dir), t.corpus(spark, sf_dir))


@query
def c1_merge_with_both_labels(spark, sf_dir):
    gold, corpus = t.gold_list(spark, sf_dir), t.corpus(spark, sf_dir)
    return joins.merge_with_labels(gold, corpus, labels="both", keep_keyword=True)


@query
def c2_label_augmented(spark, sf_dir):
    return joins.label_augmented(t.augmented(spark, sf_dir), t.corpus(spark, sf_dir))


def _gold_and_predictions(spark, sf_dir):
    """An ordered split list and the keyless predictions that belong to it."""
    predicted = t.corpus(spark, sf_dir).select("par_id", t.prediction().alias("prediction"))
    gold = with_row_index(t.gold_list(spark, sf_dir), "par_id")
    return gold, with_row_index(predicted, "par_id").select("row_idx", "prediction")


@query
def c3_attach_by_position(spark, sf_dir):
    return joins.attach_by_position(*_gold_and_predictions(spark, sf_dir)).select("row_idx", "par_id", "prediction")


@query
def c4_anti_join_by_key(spark, sf_dir):
    return joins.anti_join_by_key(t.all_list(spark, sf_dir), t.gold_list(spark, sf_dir))


@query
def c4_anti_join_null_keys(spark, sf_dir):
    """Every third id is null on both sides, so those rows go as well."""
    thirds = F.when(F.col("par_id") % 3 > 0, F.col("par_id")).alias("par_id")
    everything = t.documents(spark, sf_dir).select(thirds, F.col("source").alias("label"))
    return joins.anti_join_by_key(everything, t.gold_list(spark, sf_dir).select(thirds))


@query
@rounded
def c5_vector_pairs(spark, sf_dir):
    vectors = t.load(spark, sf_dir, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("a"), F.col("label").cast("long").alias("b"))
    return joins.vector_pairs(pairs, vectors, "a", "b", "vec_id", "embedding")


# Reports.


@query
def d1_confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(t.evaluated(spark, sf_dir))


@query
def d2_confusion_counts_graded(spark, sf_dir):
    graded = t.evaluated(spark, sf_dir).withColumn("label", F.col("graded"))
    return metrics.confusion_counts_graded(graded, "keyword", cutoff=2)


@query
@rounded
def d3_classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(metrics.confusion_counts(t.evaluated(spark, sf_dir), "country_code"))


@query
@rounded
def d4_metrics_by_length(spark, sf_dir):
    return metrics.metrics_by_length(t.evaluated(spark, sf_dir))


@query
@rounded
def d5_metrics_by_graded_label(spark, sf_dir):
    return metrics.metrics_by_graded_label(t.evaluated(spark, sf_dir).withColumn("label", F.col("graded")))


@query
@rounded
def d6_metrics_by_keyword(spark, sf_dir):
    return metrics.metrics_by_keyword(t.evaluated(spark, sf_dir))


@query
def d7_class_counts(spark, sf_dir):
    return metrics.class_counts(joins.merge_with_labels(t.all_list(spark, sf_dir), t.corpus(spark, sf_dir)))


def _both_lists(spark, sf_dir):
    """Train and dev rows with text features and keyword."""
    corpus = t.corpus(spark, sf_dir)
    return sampling.concat(
        *[gold_rows(split(spark, sf_dir), corpus, strict=False) for split in (t.train_list, t.dev_list)]
    )


@query
@rounded
def d8_positive_rate_by_bin(spark, sf_dir):
    return metrics.positive_rate_by_bin(_both_lists(spark, sf_dir))


@query
def d9_keyword_counts(spark, sf_dir):
    return metrics.keyword_counts(_both_lists(spark, sf_dir))


@query
def d10_keyword_label_pivot(spark, sf_dir):
    return metrics.keyword_label_pivot(t.corpus(spark, sf_dir))


@query
def d10_keyword_label_pivot_all_labels(spark, sf_dir):
    """Grades up to 8."""
    corpus = t.corpus(spark, sf_dir)
    return metrics.keyword_label_pivot(corpus.withColumn("label", F.col("label") * 2))


@query
def d11_histogram_by_class(spark, sf_dir):
    return metrics.histogram_by_class(_both_lists(spark, sf_dir), "word_count")


@query
@rounded
def d11_histogram_all_bins(spark, sf_dir):
    return metrics.histogram_bins(_both_lists(spark, sf_dir), "word_count")


@query
def d12_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(t.evaluated(spark, sf_dir))


@query
@rounded
def d13_evaluate_scores(spark, sf_dir):
    return metrics.evaluate_scores(t.scores(spark, sf_dir), "split")


@query
def d14_select_runs(spark, sf_dir):
    return metrics.select_runs(t.runs(spark, sf_dir), min_f1=0.35, split="dev")


@query
def d14_best_run(spark, sf_dir):
    return metrics.best_run(t.runs(spark, sf_dir))


# Samples and sets.


@query
def e1_sample_n(spark, sf_dir):
    return sampling.sample_n(t.documents(spark, sf_dir).select("par_id", "lang"), 150, key=["par_id"])


@query
def e2_sample_n_or_fail(spark, sf_dir):
    rows = t.documents(spark, sf_dir).select("par_id", "lang")
    return sampling.sample_n(rows, 190, seed=7, key=["par_id"], on_short="error")


@query
def e3_sample_frac(spark, sf_dir):
    return sampling.sample_frac(t.documents(spark, sf_dir).select("par_id", "lang"), 0.35, key=["par_id"])


@query
def e4_shuffle_rows(spark, sf_dir):
    return sampling.shuffle_rows(t.documents(spark, sf_dir).select("par_id", "lang"), key=["par_id"])


def _rebalanced(spark, sf_dir, down_ratio, up_ratio):
    corpus = t.corpus(spark, sf_dir)
    train = stage(joins.merge_with_labels(t.train_list(spark, sf_dir), corpus.drop("text")))
    extra = stage(joins.label_augmented(t.augmented(spark, sf_dir).drop("text"), corpus.drop("text")))
    return sampling.rebalance(train, extra, down_ratio, up_ratio)


@query
def e5_rebalance(spark, sf_dir):
    return _rebalanced(spark, sf_dir, 3, 2.5)


@query
def e5_rebalance_partly_augmented(spark, sf_dir):
    return _rebalanced(spark, sf_dir, 2, 1.5)


@query
def e6_split_train_valid(spark, sf_dir):
    train, valid = sampling.split_train_valid(stage(_rebalanced(spark, sf_dir, 3, 2.5)))
    return sampling.concat(train.withColumn("side", F.lit("train")), valid.withColumn("side", F.lit("valid")))


@query
def e6_split_by_id(spark, sf_dir):
    """Copies of a row share its id, and lie on one side with it."""
    train, valid = sampling.split_by_id(_rebalanced(spark, sf_dir, 3, 2.5))
    return sampling.concat(train.withColumn("side", F.lit("train")), valid.withColumn("side", F.lit("valid")))


@query
def e7_concat(spark, sf_dir):
    train, dev, extra = (part(spark, sf_dir) for part in (t.train_list, t.dev_list, t.augmented))
    return sampling.concat(train, dev, extra)


@query
@rounded
def e8_sort_by_metric(spark, sf_dir):
    by_language = metrics.classification_metrics(metrics.confusion_counts(t.evaluated(spark, sf_dir), "country_code"))
    return metrics.sort_by_metric(by_language, "accuracy", "country_code")


# Text and models.


def _joined(array: str):
    return F.array_join(F.col(array).cast("array<string>"), ",").alias(array)


@query
def f1_encode_tokens(spark, sf_dir):
    texts = t.documents(spark, sf_dir).select("par_id", "text")
    encoded = tokens.encode_tokens(texts, tokens.build_vocab(texts))
    return encoded.select("par_id", _joined("input_ids"), _joined("attention_mask"))


@query
def f2_build_vocab(spark, sf_dir):
    return tokens.build_vocab(t.documents(spark, sf_dir), min_count=2)


@query
def f1_encode_repeated_ids(spark, sf_dir):
    """Every text under an id that others have too or that is null."""
    shared = F.when(F.col("par_id") % 7 > 0, F.col("par_id") % 7)
    texts = t.documents(spark, sf_dir).select(shared.alias("par_id"), "text")
    encoded = tokens.encode_tokens(texts, tokens.build_vocab(texts))
    return encoded.select("par_id", _joined("input_ids"), F.md5("text").alias("text_md5"))


@query
def f3_sentences_of_words(spark, sf_dir):
    spoken = tokens.sentences_of_words(t.documents(spark, sf_dir), "par_id")
    return spoken.withColumn("words", F.array_join("words", " "))


@query
@rounded
def f3_learn_abbreviations(spark, sf_dir):
    """All words that a full stop follows, with their scores."""
    return tokens.learn_abbreviations(t.documents(spark, sf_dir), least=float("-inf"))


@query
def f4_train_word_vectors(spark, sf_dir):
    """Vectors in millionths, so that they are whole numbers."""
    spoken = tokens.sentences_of_words(t.documents(spark, sf_dir), "par_id")
    vectors = train_word_vectors(spoken)
    millionths = F.transform("vector", lambda x: F.round(x * 1e6).cast("long"))
    return vectors.select("word", "n", F.array_join(millionths.cast("array<string>"), ",").alias("vector"))


@query
def f4_count_neighbours(spark, sf_dir):
    spoken = tokens.sentences_of_words(t.documents(spark, sf_dir), "par_id")
    return count_neighbours(spoken)


@query
@rounded
def f5_cosine(spark, sf_dir):
    """Every vector against the one with the next id."""
    vectors = t.load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = vectors.join(following, "vec_id")
    return pairs.select("vec_id", cosine(F.col("embedding"), F.col("next")).alias("similarity"))


def _training_rows(spark, sf_dir):
    """Labelled documents to train on and to validate with."""
    rows = stage(t.evaluated(spark, sf_dir).select("par_id", "keyword", "text", "label"))
    return sampling.split_train_valid(rows, key=["par_id"])


@query
@rounded
def f6_train_text_classifier(spark, sf_dir):
    _, log = classifier.train_text_classifier(*_training_rows(spark, sf_dir))
    return log


def _scored(scores):
    return scores.withColumn("margin", F.col("logits")[1] - F.col("logits")[0]).drop("logits")


@query
@rounded
def f7_score(spark, sf_dir):
    train, valid = _training_rows(spark, sf_dir)
    model, _ = classifier.train_text_classifier(train, valid, epochs=2)
    texts = t.documents(spark, sf_dir).select(F.col("par_id").alias("row_idx"), "text")
    return _scored(classifier.score(model, texts).select("row_idx", "logits", "prediction"))


def _length_scorer():
    """A scorer that takes long texts for positive."""
    return lambda texts: np.column_stack([np.full(len(texts), 1000.0), texts.str.len()])


@query
def f7_score_with(spark, sf_dir):
    texts = t.documents(spark, sf_dir).select(F.col("par_id").alias("row_idx"), "text")
    scored = classifier.score_with(texts, _length_scorer)
    return scored.select("row_idx", F.col("logits")[1].alias("logit_1"), "prediction")


@query
@rounded
def f8_search_hyperparameters(spark, sf_dir):
    train, valid = _training_rows(spark, sf_dir)
    dev = joins.merge_with_labels(t.dev_list(spark, sf_dir), t.corpus(spark, sf_dir))
    runs = classifier.search_hyperparameters(train, valid, dev)
    return runs.withColumn("learning_rate", F.col("learning_rate") * 1e5)


@query
@rounded
def f9_evaluate_baseline(spark, sf_dir):
    rows = t.evaluated(spark, sf_dir).select("par_id", "label")
    guess = classifier.evaluate_baseline(rows, classifier.hash_scorer(["par_id"]))
    never = classifier.evaluate_baseline(rows, classifier.constant_scorer(0))
    return sampling.concat(
        guess.withColumn("scorer", F.lit("guess")), never.withColumn("scorer", F.lit("constant"))
    )


@query
def f10_augment_text(spark, sf_dir):
    rows = t.evaluated(spark, sf_dir).select("par_id", "label", "text")
    return tokens.augment_text(rows, lambda texts: "bt " + texts, copy_no="bt")


@query
def f10_augment_text_once(spark, sf_dir):
    """All texts, some of which several rows have, paraphrased by two runs over one memo."""
    texts = t.documents(spark, sf_dir).select("par_id", "text")
    memo = fresh_path(spark, "memo")
    tokens.augment_text_once(texts.filter("par_id % 3 = 0"), lambda texts: "bt " + texts, "bt", memo, parts=2)
    found = tokens.augment_text_once(texts, lambda texts: "again " + texts, "bt", memo, parts=2)
    return found.select("par_id", F.md5("text").alias("text_md5"), "origin", "copy_no", "error")


@query
@rounded
def f11_save_and_load_model(spark, sf_dir):
    train, valid = _training_rows(spark, sf_dir)
    model, _ = classifier.train_text_classifier(train, valid, epochs=1)
    path = fresh_path(spark, "model")
    classifier.save_model(model, path)
    scored = classifier.score(classifier.load_model(spark, path), valid)
    return _scored(scored.select("par_id", "logits", "prediction"))


# Complete flows.


@query
@rounded
def flow_metrics_by_keyword(spark, sf_dir):
    """Split list, corpus and keyless predictions to metrics by keyword."""
    gold, predictions = _gold_and_predictions(spark, sf_dir)
    return metrics.metrics_by_keyword(evaluated_rows(gold, t.corpus(spark, sf_dir), predictions))


@query
@rounded
def flow_error_slices(spark, sf_dir):
    gold, predictions = _gold_and_predictions(spark, sf_dir)
    return error_slices(evaluated_rows(gold, t.corpus(spark, sf_dir), predictions))


@query
@rounded
def flow_data_report(spark, sf_dir):
    """All tables of the report on the data in one long form."""
    lists = t.train_list(spark, sf_dir), t.dev_list(spark, sf_dir)
    report = data_report(*lists, t.corpus(spark, sf_dir))
    said = lambda name, key, part, value: (F.lit(name).alias("report"), key.alias("key"), part.alias("part"), value.cast("double").alias("value"))
    text = lambda column: F.col(column).cast("string")
    grades = [F.struct(F.lit(str(g)).alias("part"), F.col(f"label_{g}").alias("value")) for g in range(5)]
    return sampling.concat(
        report.classes.select(*said("classes", F.lit("all"), text("label"), F.col("n"))),
        report.positive_rate.select(*said("positive_rate", bin_label(F.col("bin_left"), F.col("bin_right")), F.lit("1"), F.col("ratio"))),
        report.word_counts.select(*said("word_counts", text("bin"), text("label"), F.col("n"))),
        report.keywords.select(*said("keywords", F.col("keyword"), F.lit("all"), F.col("n"))),
        report.grades.select("keyword", F.inline(F.array(*grades))).select(*said("grades", F.col("keyword"), F.col("part"), F.col("value"))),
    )


@query
def flow_training_sets(spark, sf_dir):
    sets = training_sets(t.train_list(spark, sf_dir), t.corpus(spark, sf_dir), t.augmented(spark, sf_dir))
    sides = (sets.train.withColumn("side", F.lit("train")), sets.valid.withColumn("side", F.lit("valid")))
    return sampling.concat(*sides)


@query
def flow_augmented_training(spark, sf_dir):
    """Paraphrases, some of which fail, through their files into a balanced set; corpus ids repeat."""
    rows = t.evaluated(spark, sf_dir).select("par_id", "text")

    def paraphrase(texts):
        if (texts.str.len() % 5 == 0).any():
            raise ValueError("no paraphrase")
        return "bt " + texts

    path = fresh_path(spark, "augmented")
    tables.write_augmented(tokens.augment_text(rows, paraphrase, "bt"), path, failed_path=fresh_path(spark, "failed"))
    corpus = t.corpus(spark, sf_dir)
    twice = sampling.concat(corpus, corpus.filter(F.col("par_id") % 4 == 0))
    pool = joins.label_augmented(tables.read_augmented(spark, path), twice)
    return pool.select("par_id", "origin", "copy_no", "label", F.md5("text").alias("text_md5"))


@query
@rounded
def flow_single_run(spark, sf_dir):
    """A run that is stored twice, and read back from disk: both score sets with labels and metrics."""
    train, valid = _training_rows(spark, sf_dir)
    dev = joins.merge_with_labels(t.dev_list(spark, sf_dir), t.corpus(spark, sf_dir))
    dev = dev.withColumn("row_idx", F.col("par_id"))
    texts = t.documents(spark, sf_dir).select(F.col("par_id").alias("row_idx"), "text")
    output = fresh_path(spark, "runs")
    # Any run is good enough here.
    for epochs in (1, 2):
        single_run(train, valid, dev, texts, output, "run-1", min_f1=-1.0, epochs=epochs)
    metrics = F.broadcast(run_store.read_runs(spark, output).select("run_id", "metrics.dev_f1", "metrics.dev_accuracy"))
    return _scored(run_store.read_run_scores(spark, output).join(metrics, "run_id"))


@query
def flow_rewritten_scores(spark, sf_dir):
    """Scores of a run that is written twice."""
    path = fresh_path(spark, "scores")
    whole = t.scores(spark, sf_dir)
    scores.write_scores(whole.withColumn("logits", F.reverse("logits")), path)
    scores.write_scores(whole, path)
    stored = scores.read_scores(spark, path)
    logits = [F.col("logits")[i].alias(f"logit_{i}") for i in range(2)]
    return stored.select("run_id", "split", "row_idx", *logits)


@query
def c3_attach_fanned_out(spark, sf_dir):
    """Predictions of the merged rows where every fourth id has two corpus rows."""
    corpus = t.corpus(spark, sf_dir)
    twice = sampling.concat(corpus, corpus.filter(F.col("par_id") % 4 == 0))
    listed = with_row_index(t.gold_list(spark, sf_dir), "par_id")
    copies = F.when(F.col("par_id") % 4 == 0, 2).otherwise(1)
    said = twice.select("par_id").distinct().withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    said = with_row_index(said, "par_id", "copy")
    predictions = said.select("row_idx", ((F.col("par_id") + F.col("copy")) % 2).alias("prediction"))
    found = evaluated_rows(listed, twice, predictions)
    return found.select("row_idx", "par_id", "prediction")


@query
def flow_label_files(spark, sf_dir):
    path, output = fresh_path(spark, "scores"), fresh_path(spark, "labels")
    whole = t.scores(spark, sf_dir)
    scores.write_scores(whole, path)
    folders = write_label_files(spark, path, "run-1", output)
    return sampling.concat(
        *[lines.read_indexed_lines(spark, folder).withColumn("split", F.lit(split)) for split, folder in folders.items()]
    )


@query
@rounded
def flow_word_similarity(spark, sf_dir):
    """Similarity of every frequent word to the most frequent one of its length."""
    texts = t.documents(spark, sf_dir).select("par_id", "text")
    frequent = tokens.build_vocab(texts, min_count=5)
    leaders = frequent.groupBy(F.length("token").alias("n_chars")).agg(F.min_by("token", "id").alias("b"))
    pairs = frequent.select(F.col("token").alias("a"), F.length("token").alias("n_chars")).join(leaders, "n_chars")
    return word_similarity(texts, pairs.select("a", "b"))
